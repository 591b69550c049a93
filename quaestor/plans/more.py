"""Further plans: exports, narratives, PDF metadata and workflow reads over small bindings."""

_DOCS = "{entities} e JOIN {mentions} m ON e.id = m.entity_id JOIN {docs} d ON d.id = m.document_id"

PLANS = {
    "narrative_people": f"SELECT e.id, e.name, count(DISTINCT d.id) AS n FROM {_DOCS} WHERE e.type = 'person' GROUP BY e.id, e.name ORDER BY n DESC, e.id LIMIT 20",
    "narrative_finance": "SELECT indicator_type, count(*) AS n, max(risk) AS most FROM {indicators} GROUP BY indicator_type",
    "narrative_timeline": "SELECT v.id, v.event_date, v.context FROM {dated} v JOIN {event_entities} x ON x.event_id = v.id WHERE x.entity_id = 7 AND v.event_date IS NOT NULL ORDER BY v.event_date, v.id LIMIT 50",
    "export_intel_brief": "SELECT label, severity, count(*) AS n FROM {facts} WHERE analysis_type = 'aml_flag' AND document_id IN (SELECT document_id FROM {facts} WHERE analysis_type = 'risk_score' AND percent >= 50) GROUP BY label, severity",
    "export_report_dates": "SELECT event_date, count(*) AS n FROM {dated} WHERE length(event_date) >= 10 GROUP BY event_date ORDER BY n DESC, event_date LIMIT 10",
    "export_connections": "SELECT a.name AS name_a, a.type AS type_a, b.name AS name_b, b.type AS type_b, l.entity_a_id, l.entity_b_id, l.weight FROM {links} l JOIN {entities} a ON a.id = l.entity_a_id JOIN {entities} b ON b.id = l.entity_b_id WHERE l.weight >= 1 ORDER BY l.weight DESC, l.entity_a_id, l.entity_b_id LIMIT 500",
    "document_sentiment": "SELECT label, count(*) AS n, round(avg(percent), 6) AS mean FROM {facts} WHERE analysis_type = 'tone' GROUP BY label",
    "document_sentiment_severity": "SELECT severity, count(*) AS n FROM {facts} GROUP BY severity",
    "search_history_stats": "SELECT query, count(*) AS n, max(searched_at) AS last_at, max_by(results, searched_at) AS results FROM (SELECT query, searched_at, max(results) AS results FROM {history} GROUP BY query, searched_at) x GROUP BY query",
    "entity_aliases_list": "SELECT a.alias_name, e.id, e.name, e.type FROM {aliases} a JOIN {entities} e ON e.id = a.entity_id",
    "entity_alias_type_breakdown": "SELECT type, n_aliases, n_entities, round(CAST(100 AS DOUBLE) * n_aliases / sum(n_aliases) OVER (), 4) AS percent FROM (SELECT e.type, CAST(count(*) AS DOUBLE) AS n_aliases, count(DISTINCT e.id) AS n_entities FROM {aliases} a JOIN {entities} e ON e.id = a.entity_id GROUP BY e.type) x",
    "entity_pair_codocs": "SELECT x.entity_id AS id_a, y.entity_id AS id_b, count(DISTINCT x.document_id) AS shared FROM {mentions} x JOIN {mentions} y ON x.document_id = y.document_id AND x.entity_id < y.entity_id GROUP BY 1, 2 ORDER BY shared DESC, 1, 2 LIMIT 100",
    "entity_co_occurrence": "SELECT entity_a_id, entity_b_id, weight AS shared FROM {links} ORDER BY weight DESC, 1, 2 LIMIT 100",
    "financial_summary": "SELECT indicator_type, count(*) AS n, round(avg(risk), 2) AS mean, max(risk) AS most FROM {indicators} GROUP BY indicator_type",
    "financial_summary_top": "SELECT document_id, indicator_type, value, risk FROM {indicators} ORDER BY risk DESC, document_id, value, indicator_type LIMIT 50",
    "entity_connections_timeline": f"SELECT d.ingest_day, count(DISTINCT e.id) AS n_entities, count(DISTINCT d.id) AS n_docs FROM {_DOCS} GROUP BY d.ingest_day",
    "document_category_timeline": "SELECT ingest_day, count(CASE WHEN category = 'deposition' THEN 1 END) AS deposition, count(CASE WHEN category = 'report' THEN 1 END) AS report, count(CASE WHEN category = 'legal' THEN 1 END) AS legal, count(CASE WHEN category = 'correspondence' THEN 1 END) AS correspondence, count(CASE WHEN category = 'flight' THEN 1 END) AS flight FROM {docs} GROUP BY ingest_day",
    "event_resolution_breakdown": "SELECT d.source, count(CASE WHEN v.is_resolved THEN 1 END) AS resolved, count(CASE WHEN NOT coalesce(v.is_resolved, false) THEN 1 END) AS unresolved FROM {dated} v JOIN {docs} d ON d.id = v.document_id GROUP BY d.source",
    "source_flagged_ratio": "SELECT coalesce(source, 'unknown') AS source, round(CAST(100 AS DOUBLE) * sum(CASE WHEN flagged THEN 1 ELSE 0 END) / count(*), 4) AS percent FROM {docs} GROUP BY 1",
    "connection_weight_histogram": "SELECT weight, count(*) AS n FROM {links} GROUP BY weight",
    "source_page_volume": "SELECT source, CAST(sum(pages) AS BIGINT) AS pages, round(avg(pages), 6) AS mean, max(pages) AS most FROM {docs} GROUP BY source",
    "source_entity_concentration": "SELECT d.source, round(CAST(count(DISTINCT m.entity_id) AS DOUBLE) / count(DISTINCT d.id), 6) AS per_doc FROM {docs} d LEFT JOIN {mentions} m ON m.document_id = d.id GROUP BY d.source",
    "source_category_coverage": "SELECT coalesce(source, 'unknown') AS source, coalesce(category, 'uncategorized') AS category, count(*) AS n FROM {docs} GROUP BY 1, 2",
    "source_ingestion_cadence": "SELECT source, count(*) AS n, min(ingest_day) AS first_day, max(ingest_day) AS last_day FROM {docs} GROUP BY source",
    "source_entity_type_mix": f"SELECT d.source, e.type, count(DISTINCT e.id) AS n FROM {_DOCS} GROUP BY d.source, e.type",
    "depositions": "SELECT e.id, e.name, count(DISTINCT d.id) AS n, CAST(sum(m.count) AS BIGINT) AS mentions FROM {docs} d JOIN {mentions} m ON m.document_id = d.id JOIN {entities} e ON e.id = m.entity_id WHERE d.category ILIKE 'deposition' AND e.type = 'person' GROUP BY e.id, e.name",
    "document_age_distribution": "SELECT CASE WHEN age < 400 THEN '<400' WHEN age < 800 THEN '400-799' WHEN age < 1600 THEN '800-1599' ELSE '1600+' END AS bucket, count(*) AS n FROM (SELECT DAYS(ingest_day, '2001-12-31') AS age FROM {docs}) x GROUP BY 1",
    "pdf_metadata_authors": "SELECT author, count(*) AS n FROM {pdf_metadata} WHERE author <> '' GROUP BY author ORDER BY n DESC, author LIMIT 10",
    "pdf_metadata_stats": "SELECT count(*) AS total, count(CASE WHEN encrypted THEN 1 END) AS encrypted, min(creation_date) AS first_date, max(modification_date) AS last_date, count(DISTINCT producer) AS producers FROM {pdf_metadata}",
    "pdf_metadata_search": "SELECT p.document_id, d.title, p.author, p.producer FROM {pdf_metadata} p JOIN {docs} d ON d.id = p.document_id WHERE p.author ILIKE '%building%' AND p.producer ILIKE '%1%' ORDER BY p.document_id LIMIT 50",
    "pdf_metadata_timeline": "SELECT document_id, coalesce(creation_date, modification_date) AS day FROM {pdf_metadata} WHERE coalesce(creation_date, modification_date) IS NOT NULL",
    "pdf_metadata_missing": "SELECT d.id FROM {docs} d LEFT JOIN {pdf_metadata} p ON p.document_id = d.id WHERE d.filename LIKE '%.pdf' AND p.document_id IS NULL",
    "pdf_producer_inconsistencies": "SELECT author, count(DISTINCT producer) AS n, JOINED(producer) AS producers FROM {pdf_metadata} WHERE author <> '' AND producer <> '' GROUP BY author HAVING count(DISTINCT producer) >= 3",
    "pdf_date_inconsistencies": "SELECT document_id, 'created_after_modified' AS problem FROM {pdf_metadata} WHERE creation_date > modification_date UNION ALL SELECT document_id, 'future_creation' FROM {pdf_metadata} WHERE creation_date > '2001-01-01'",
    "pdf_metadata_stripping": "SELECT document_id, CASE WHEN producer = '' AND creator = '' THEN 'medium' ELSE 'low' END AS severity FROM {pdf_metadata} WHERE author = ''",
    "graph_centrality_weighted": "SELECT id, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT entity_a_id AS id, weight FROM {links} UNION ALL SELECT entity_b_id, weight FROM {links}) x GROUP BY id ORDER BY weight DESC, id LIMIT 50",
    "graph_subgraph": "SELECT entity_a_id, entity_b_id, weight FROM {links} WHERE entity_a_id IN (SELECT entity_id FROM {tags} WHERE tag = 'key') AND entity_b_id IN (SELECT entity_id FROM {tags} WHERE tag = 'key')",
    "entity_path_two_hops": "SELECT DISTINCT y.partner AS id FROM (SELECT entity_a_id AS id, entity_b_id AS partner FROM {links} WHERE weight >= 2 UNION ALL SELECT entity_b_id, entity_a_id FROM {links} WHERE weight >= 2) x JOIN (SELECT entity_a_id AS id, entity_b_id AS partner FROM {links} WHERE weight >= 2 UNION ALL SELECT entity_b_id, entity_a_id FROM {links} WHERE weight >= 2) y ON y.id = x.partner WHERE x.id = 7",
    "resolver_duplicates": "SELECT r.source_entity_id, s.name AS source_name, r.canonical_entity_id, c.name AS canonical_name FROM {resolutions} r JOIN {entities} s ON s.id = r.source_entity_id JOIN {entities} c ON c.id = r.canonical_entity_id",
    "tags_watchlist": "SELECT e.id, e.name, count(DISTINCT m.document_id) AS docs FROM {tags} t JOIN {entities} e ON e.id = t.entity_id LEFT JOIN {mentions} m ON m.entity_id = e.id WHERE t.tag = 'seen' GROUP BY e.id, e.name",
    "conversation_turns": "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, CAST(max(turn) AS BIGINT) AS last_turn FROM {conversations} GROUP BY role",
    "conversation_pairs": "SELECT a.role AS role_a, b.role AS role_b, count(*) AS n FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY a.role, b.role",
    "events_by_user": "SELECT user_id, event_type, count(*) AS n, round(max(value), 6) AS most FROM {activity} GROUP BY user_id, event_type",
    "events_by_day": "SELECT day, event_type, count(*) AS n FROM {activity} GROUP BY day, event_type",
    "events_user_gaps": "SELECT user_id, max(gap) AS longest FROM (SELECT user_id, DAYS(lag(day) OVER (PARTITION BY user_id ORDER BY day, event_id), day) AS gap FROM {activity}) x GROUP BY user_id",
}
