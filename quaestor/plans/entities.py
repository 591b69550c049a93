"""Plans about entities and their mentions."""

_STATS = "{entities} e JOIN {mentions} m ON e.id = m.entity_id"
_DOCS = _STATS + " JOIN {docs} d ON d.id = m.document_id"
_TOTALS = "count(DISTINCT m.document_id) AS doc_count, CAST(sum(m.count) AS BIGINT) AS mentions"

PLANS = {
    "list_all_tags": "SELECT tag, count(*) AS n FROM {tags} GROUP BY tag",
    "tag_analytics_by_type": "SELECT t.tag, e.type, count(*) AS n FROM {tags} t JOIN {entities} e ON e.id = t.entity_id GROUP BY t.tag, e.type",
    "tag_analytics_pairs": "SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM {tags} a JOIN {tags} b ON a.entity_id = b.entity_id AND a.tag < b.tag GROUP BY a.tag, b.tag",
    "tag_analytics_top": "SELECT e.id, e.name, count(*) AS n_tags, JOINED(t.tag) AS tags FROM {tags} t JOIN {entities} e ON e.id = t.entity_id GROUP BY e.id, e.name ORDER BY n_tags DESC, e.id LIMIT 20",
    "bulk_tag_candidates": "SELECT e.id, CAST(sum(m.count) AS BIGINT) AS mentions FROM " + _STATS + " WHERE e.type = 'org' GROUP BY e.id HAVING sum(m.count) >= 900",
    "merge_entities": "SELECT document_id, CASE WHEN entity_id = 5 THEN 9 ELSE entity_id END AS entity_id, CAST(sum(count) AS BIGINT) AS count FROM {mentions} WHERE entity_id IN (5, 9, 11) GROUP BY 1, 2",
    "entity_path_suggestions": f"SELECT e.id, e.name, e.type, count(DISTINCT m.document_id) AS doc_count FROM {_STATS} GROUP BY e.id, e.name, e.type ORDER BY doc_count DESC, e.id LIMIT 200",
    "entity_frequency": f"WITH top AS (SELECT e.id, e.name, sum(m.count) AS n FROM {_STATS} WHERE e.type = 'person' GROUP BY e.id, e.name ORDER BY n DESC, e.id LIMIT 20) SELECT t.id, t.name, substr(d.date, 1, 4) AS year, CAST(sum(m.count) AS BIGINT) AS mentions FROM top t JOIN {{mentions}} m ON m.entity_id = t.id JOIN {{docs}} d ON d.id = m.document_id GROUP BY t.id, t.name, substr(d.date, 1, 4)",
    "location_frequency": f"SELECT e.id, e.name, {_TOTALS}, count(DISTINCT d.category) AS n_categories, JOINED(d.category) AS categories, count(DISTINCT d.source) AS n_sources FROM {_DOCS} WHERE e.type = 'place' GROUP BY e.id, e.name",
    "location_pairs": "SELECT a.id AS id_a, b.id AS id_b, l.weight FROM {links} l JOIN {entities} a ON a.id = l.entity_a_id JOIN {entities} b ON b.id = l.entity_b_id WHERE a.type = 'place' AND b.type = 'place' AND l.weight >= 2",
    "geo_locations": f"WITH top AS (SELECT e.id, e.name, {_TOTALS} FROM {_STATS} WHERE e.type = 'place' GROUP BY e.id, e.name ORDER BY mentions DESC, e.id LIMIT 50), r AS (SELECT t.id, t.name, t.mentions, d.id AS document_id, m.count, row_number() OVER (PARTITION BY t.id ORDER BY m.count DESC, d.id) AS rank FROM top t JOIN {{mentions}} m ON m.entity_id = t.id JOIN {{docs}} d ON d.id = m.document_id) SELECT * FROM r WHERE rank <= 3",
    "witness_overlap": f"SELECT e.id, e.name, count(DISTINCT d.id) AS doc_count FROM {_DOCS} WHERE d.category = 'deposition' OR d.title ILIKE '%deposition%' GROUP BY e.id, e.name HAVING count(DISTINCT d.id) >= 2",
    "entity_coappearances": "SELECT a.id AS id_a, a.name AS name_a, b.id AS id_b, b.name AS name_b, count(DISTINCT x.document_id) AS shared_docs, CAST(sum(x.count + y.count) AS BIGINT) AS combined_mentions FROM {mentions} x JOIN {mentions} y ON x.document_id = y.document_id AND x.entity_id < y.entity_id JOIN {entities} a ON a.id = x.entity_id JOIN {entities} b ON b.id = y.entity_id GROUP BY a.id, a.name, b.id, b.name ORDER BY shared_docs DESC, combined_mentions DESC, id_a, id_b LIMIT 50",
    "unresolved_entities": "SELECT e.id, e.name, e.type, count(DISTINCT m.document_id) AS doc_count FROM {entities} e LEFT JOIN {mentions} m ON m.entity_id = e.id WHERE NOT EXISTS (SELECT 1 FROM {resolutions} r WHERE r.source_entity_id = e.id) AND NOT EXISTS (SELECT 1 FROM {resolutions} r WHERE r.canonical_entity_id = e.id) GROUP BY e.id, e.name, e.type",
    "unresolved_entities_summary": "SELECT e.id, e.name, count(DISTINCT m.document_id) AS doc_count FROM {entities} e JOIN {mentions} m ON m.entity_id = e.id WHERE e.id NOT IN (SELECT source_entity_id FROM {resolutions}) AND e.id NOT IN (SELECT canonical_entity_id FROM {resolutions}) GROUP BY e.id, e.name ORDER BY doc_count DESC, e.id LIMIT 200",
    "alias_network": "SELECT e.id, e.name, e.type, count(*) AS n_aliases, JOINED(a.alias_name) AS aliases FROM {aliases} a JOIN {entities} e ON e.id = a.entity_id GROUP BY e.id, e.name, e.type",
    "entity_aliases_by_type": "SELECT e.type, count(*) AS n_aliases, count(DISTINCT e.id) AS n_entities FROM {aliases} a JOIN {entities} e ON e.id = a.entity_id GROUP BY e.type",
    "entity_alias_coverage": "SELECT count(*) AS total, count(a.entity_id) AS with_alias FROM {entities} e LEFT JOIN (SELECT DISTINCT entity_id FROM {aliases}) a ON a.entity_id = e.id",
    "entity_alias_chain": "SELECT e.id, e.name, count(*) AS n FROM {aliases} a JOIN {entities} e ON e.id = a.entity_id GROUP BY e.id, e.name ORDER BY n DESC, e.id LIMIT 50",
    "entity_multi_alias_ratio": "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' ELSE '11+' END AS bucket FROM (SELECT entity_id, count(*) AS n FROM {aliases} GROUP BY entity_id) x) y GROUP BY bucket",
    "resolution_audit": "SELECT r.source_entity_id, s.name AS source_name, r.canonical_entity_id, c.name AS canonical_name FROM {resolutions} r JOIN {entities} s ON s.id = r.source_entity_id JOIN {entities} c ON c.id = r.canonical_entity_id",
    "entity_resolution_coverage": "SELECT count(DISTINCT source_entity_id) AS resolved, count(DISTINCT canonical_entity_id) AS canonical FROM {resolutions}",
    "entity_resolution_top": "SELECT e.id, e.name, count(*) AS n FROM {resolutions} r JOIN {entities} e ON e.id = r.canonical_entity_id GROUP BY e.id, e.name ORDER BY n DESC, e.id LIMIT 20",
    "entity_type_breakdown": "SELECT type, count(*) AS n FROM {entities} GROUP BY type",
    "entity_type_top20": f"WITH s AS (SELECT e.type, e.id, e.name, sum(m.count) AS n FROM {_STATS} GROUP BY e.type, e.id, e.name) SELECT type, id, name, CAST(n AS BIGINT) AS mentions, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, id) AS rank FROM s) x WHERE rank <= 20",
    "entity_orphans": "SELECT count(*) AS orphans FROM {entities} e WHERE NOT EXISTS (SELECT 1 FROM {mentions} m WHERE m.entity_id = e.id)",
    "entity_first_last": f"SELECT e.id, e.name, min(d.date) AS first_date, max(d.date) AS last_date, count(DISTINCT d.id) AS doc_count, DAYS(min(d.date), max(d.date)) AS span_days FROM {_DOCS} GROUP BY e.id, e.name",
    "cross_source_entities": f"SELECT e.id, e.name, e.type, count(DISTINCT d.source) AS n_sources, JOINED(d.source) AS sources FROM {_DOCS} GROUP BY e.id, e.name, e.type HAVING count(DISTINCT d.source) >= 2 ORDER BY n_sources DESC, e.id LIMIT 100",
    "multi_source_entities": f"SELECT e.id, e.name, count(DISTINCT d.source) AS n_sources FROM {_DOCS} GROUP BY e.id, e.name HAVING count(DISTINCT d.source) >= 3",
    "source_cross_reference": f"SELECT e.id, count(DISTINCT d.source) AS n_sources, count(DISTINCT d.id) AS n_docs FROM {_DOCS} GROUP BY e.id HAVING count(DISTINCT d.source) > 1",
    "entity_name_length": "SELECT bucket, count(*) AS n, min(len) AS shortest, max(len) AS longest FROM (SELECT length(name) AS len, CASE WHEN length(name) < 10 THEN 'short' WHEN length(name) < 14 THEN 'medium' ELSE 'long' END AS bucket FROM {entities}) x GROUP BY bucket",
    "entity_name_length_stats": "SELECT avg(length(name)) AS mean, CAST(min(length(name)) AS BIGINT) AS least, CAST(max(length(name)) AS BIGINT) AS most FROM {entities}",
    "entity_name_pattern": "SELECT id, name, CAST(length(name) AS BIGINT) AS len FROM {entities} ORDER BY len DESC, id LIMIT 50",
    "entity_name_duplicates": "SELECT a.id AS id_a, b.id AS id_b, a.name FROM {entities} a JOIN {entities} b ON a.name = b.name AND a.type <> b.type AND a.id < b.id",
    # names are compared once each, then joined back to their entities
    "high_value_targets": f"WITH s AS (SELECT e.id, e.name, {_TOTALS}, count(DISTINCT d.source) AS n_sources FROM {_DOCS} WHERE e.type IN ('person', 'org') GROUP BY e.id, e.name), deg AS (SELECT id, count(*) AS degree FROM (SELECT entity_a_id AS id FROM {{links}} UNION ALL SELECT entity_b_id FROM {{links}}) x GROUP BY id), ev AS (SELECT entity_id, count(*) AS n FROM {{event_entities}} GROUP BY entity_id) SELECT s.id, s.name, round(CAST(3 AS DOUBLE) * s.doc_count + CAST(0.01 AS DOUBLE) * s.mentions + 5 * s.n_sources + 2 * coalesce(deg.degree, 0) + CAST(0.5 AS DOUBLE) * coalesce(ev.n, 0), 2) AS score FROM s LEFT JOIN deg ON deg.id = s.id LEFT JOIN ev ON ev.entity_id = s.id ORDER BY score DESC, s.id LIMIT 50",
    "influence_scores": f"WITH s AS (SELECT e.id, e.name, {_TOTALS} FROM {_STATS} GROUP BY e.id, e.name), w AS (SELECT id, sum(weight) AS weight FROM (SELECT entity_a_id AS id, weight FROM {{links}} UNION ALL SELECT entity_b_id, weight FROM {{links}}) x GROUP BY id), ev AS (SELECT entity_id, count(*) AS n FROM {{event_entities}} GROUP BY entity_id), f AS (SELECT m.entity_id, count(*) AS n FROM {{mentions}} m JOIN {{indicators}} i ON i.document_id = m.document_id GROUP BY m.entity_id) SELECT s.id, s.name, round(CAST(3 AS DOUBLE) * s.doc_count + CAST(0.1 AS DOUBLE) * s.mentions + CAST(0.5 AS DOUBLE) * CAST(coalesce(w.weight, 0) AS BIGINT) + 2 * coalesce(ev.n, 0) + 5 * coalesce(f.n, 0), 1) AS score FROM s LEFT JOIN w ON w.id = s.id LEFT JOIN ev ON ev.entity_id = s.id LEFT JOIN f ON f.entity_id = s.id ORDER BY score DESC, s.id LIMIT 50",
    "entity_pair_history": "SELECT d.id, d.title, d.date, x.count + y.count AS combined FROM (SELECT entity_a_id, entity_b_id FROM {links} ORDER BY weight DESC, entity_a_id, entity_b_id LIMIT 1) l JOIN {mentions} x ON x.entity_id = l.entity_a_id JOIN {mentions} y ON y.entity_id = l.entity_b_id AND x.document_id = y.document_id JOIN {docs} d ON d.id = x.document_id",
    "mention_heatmap": f"WITH te AS (SELECT e.id, sum(m.count) AS n FROM {_STATS} WHERE e.type IN ('person', 'org') GROUP BY e.id ORDER BY n DESC, e.id LIMIT 20), td AS (SELECT m.document_id AS id, sum(m.count) AS n FROM {{mentions}} m JOIN te ON te.id = m.entity_id GROUP BY m.document_id ORDER BY n DESC, m.document_id LIMIT 30) SELECT te.id AS entity_id, td.id AS document_id, m.count FROM {{mentions}} m JOIN te ON te.id = m.entity_id JOIN td ON td.id = m.document_id",
    "xref_matrix": f"WITH top AS (SELECT e.id, count(DISTINCT m.document_id) AS n FROM {_STATS} WHERE e.type = 'person' GROUP BY e.id ORDER BY n DESC, e.id LIMIT 30) SELECT t.id, d.source, count(DISTINCT d.id) AS n FROM top t JOIN {{mentions}} m ON m.entity_id = t.id JOIN {{docs}} d ON d.id = m.document_id GROUP BY t.id, d.source",
    "multi_mention_docs": "SELECT document_id, count(*) AS n_entities, CAST(sum(count) AS BIGINT) AS mentions FROM {mentions} GROUP BY document_id ORDER BY n_entities DESC, document_id LIMIT 50",
    "entity_document_count": f"WITH t AS (SELECT e.id, count(DISTINCT m.document_id) AS n FROM {_STATS} GROUP BY e.id ORDER BY n DESC, e.id LIMIT 100) SELECT avg(n) AS mean, max(n) AS most, count(*) AS k FROM t",
    "entity_document_reach": f"SELECT e.id, e.name, count(DISTINCT m.document_id) AS doc_count, round(CAST(100 AS DOUBLE) * count(DISTINCT m.document_id) / max(t.n), 4) AS percent FROM {_STATS} CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM {{docs}}) t GROUP BY e.id, e.name ORDER BY doc_count DESC, e.id LIMIT 100",
    "entity_growth": f"SELECT d.ingest_day, count(DISTINCT e.id) AS n_entities, count(DISTINCT d.id) AS n_docs FROM {_DOCS} GROUP BY d.ingest_day",
    "entity_type_growth": f"SELECT d.ingest_day, e.type, count(DISTINCT e.id) AS n FROM {_DOCS} GROUP BY d.ingest_day, e.type",
    "entity_first_seen": f"SELECT e.id, e.name, min(d.ingest_day) AS first_seen FROM {_DOCS} GROUP BY e.id, e.name",
    "entity_spread": f"SELECT e.id, e.name, count(DISTINCT d.id) AS n_docs, count(DISTINCT d.source) AS n_sources FROM {_DOCS} GROUP BY e.id, e.name",
    "entity_singletons": f"SELECT e.id, e.name, max(m.document_id) AS document_id FROM {_STATS} GROUP BY e.id, e.name HAVING count(DISTINCT m.document_id) = 1",
    "entity_document_exclusivity": f"SELECT e.id, e.name, e.type FROM {_STATS} GROUP BY e.id, e.name, e.type HAVING count(*) = 1 ORDER BY e.id LIMIT 200",
    "entity_type_distribution": "SELECT type, n, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (), 4) AS percent FROM (SELECT type, CAST(count(*) AS DOUBLE) AS n FROM {entities} GROUP BY type) x",
    "entity_mention_frequency": f"SELECT e.id, e.name, count(*) AS n FROM {_STATS} GROUP BY e.id, e.name ORDER BY n DESC, e.id LIMIT 100",
    "entity_type_per_source": f"SELECT d.source, e.type, count(DISTINCT e.id) AS n FROM {_DOCS} GROUP BY d.source, e.type",
    "entity_type_ratio": f"SELECT d.source, count(DISTINCT CASE WHEN e.type = 'person' THEN e.id END) AS person, count(DISTINCT CASE WHEN e.type = 'place' THEN e.id END) AS place, count(DISTINCT CASE WHEN e.type = 'org' THEN e.id END) AS org, count(DISTINCT CASE WHEN e.type = 'date' THEN e.id END) AS dates FROM {_DOCS} GROUP BY d.source",
    "entity_category_breakdown": f"SELECT d.category, e.type, count(DISTINCT e.id) AS n FROM {_DOCS} GROUP BY d.category, e.type",
    "category_entity_matrix": f"SELECT d.category, e.type, count(DISTINCT e.id) AS n_entities, CAST(sum(m.count) AS BIGINT) AS mentions FROM {_DOCS} GROUP BY d.category, e.type",
    "entity_shared_sources": f"SELECT e.id, count(DISTINCT d.source) AS n FROM {_DOCS} GROUP BY e.id",
    "entity_source_loyalty": f"SELECT e.id, e.name, count(DISTINCT d.source) AS n_sources FROM {_DOCS} GROUP BY e.id, e.name ORDER BY n_sources, e.id LIMIT 100",
    "source_entity_exclusivity": f"SELECT e.id, e.name, max(d.source) AS source FROM {_DOCS} GROUP BY e.id, e.name HAVING count(DISTINCT d.source) = 1",
    "source_unique_entities": f"WITH one AS (SELECT m.entity_id FROM {{mentions}} m JOIN {{docs}} d ON d.id = m.document_id GROUP BY m.entity_id HAVING count(DISTINCT d.source) = 1) SELECT d.source, count(DISTINCT e.id) AS n FROM {_DOCS} WHERE e.id IN (SELECT entity_id FROM one) GROUP BY d.source",
    "canonical_coverage": "SELECT type, count(*) AS total, count(CASE WHEN canonical IS NOT NULL AND canonical <> '' THEN 1 END) AS canonical FROM {entities} GROUP BY type",
    "export_entities": f"SELECT e.id, e.name, e.type, e.canonical, {_TOTALS} FROM {_STATS} GROUP BY e.id, e.name, e.type, e.canonical ORDER BY mentions DESC, e.id LIMIT 500",
    "communication_flow": "SELECT a.id AS id_a, b.id AS id_b, count(DISTINCT d.id) AS n_docs, JOINED(d.category) AS categories, min(d.date) AS first_contact, max(d.date) AS last_contact FROM {mentions} x JOIN {mentions} y ON x.document_id = y.document_id AND x.entity_id < y.entity_id JOIN {entities} a ON a.id = x.entity_id AND a.type = 'person' JOIN {entities} b ON b.id = y.entity_id AND b.type = 'person' JOIN {docs} d ON d.id = x.document_id GROUP BY a.id, b.id HAVING count(DISTINCT d.id) >= 2",
    "witness_index": f"SELECT e.id, e.name, {_TOTALS}, count(DISTINCT d.source) AS n_sources, min(d.date) AS first_date FROM {_DOCS} WHERE e.type = 'person' AND d.category IN ('deposition', 'legal', 'report') GROUP BY e.id, e.name ORDER BY doc_count DESC, mentions DESC, e.id LIMIT 50",
    "witness_codeponents": f"WITH p AS (SELECT e.id, d.id AS doc FROM {_DOCS} WHERE e.type = 'person' AND d.category IN ('deposition', 'legal', 'report')), s AS (SELECT a.id, b.id AS other, count(*) AS shared FROM p a JOIN p b ON a.doc = b.doc AND a.id <> b.id GROUP BY a.id, b.id) SELECT id, other, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) AS rank FROM s) x WHERE rank <= 10",
    "corroboration_entities": f"SELECT e.id, e.name, count(DISTINCT d.source) AS n_sources, count(DISTINCT d.id) AS n_docs FROM {_DOCS} GROUP BY e.id, e.name HAVING count(DISTINCT d.source) >= 2",
    "corroboration_pairs": "SELECT x.entity_id AS id_a, y.entity_id AS id_b, count(DISTINCT d.source) AS n_sources FROM {mentions} x JOIN {mentions} y ON x.document_id = y.document_id AND x.entity_id < y.entity_id JOIN {docs} d ON d.id = x.document_id GROUP BY x.entity_id, y.entity_id HAVING count(DISTINCT d.source) >= 2",
    "cover_name_detection": "WITH n AS (SELECT m.entity_id AS id, count(DISTINCT m.document_id) AS docs FROM {mentions} m JOIN {entities} e ON e.id = m.entity_id WHERE e.type = 'person' GROUP BY m.entity_id), s AS (SELECT x.entity_id AS id, y.entity_id AS alias, count(*) AS shared FROM {mentions} x JOIN {mentions} y ON x.document_id = y.document_id AND x.entity_id <> y.entity_id GROUP BY x.entity_id, y.entity_id HAVING count(*) >= 2) SELECT s.id, s.alias, s.shared, n2.docs AS alias_docs FROM s JOIN n n1 ON n1.id = s.id JOIN n n2 ON n2.id = s.alias WHERE n2.docs <= 20 * s.shared",
    "patterns_person_month": f"SELECT e.id, substr(d.date, 1, 7) AS month, count(DISTINCT d.id) AS n FROM {_DOCS} WHERE e.type = 'person' GROUP BY e.id, substr(d.date, 1, 7) HAVING count(DISTINCT d.id) >= 3",
    "patterns_many_categories": f"SELECT e.id, e.name, count(DISTINCT d.category) AS n FROM {_DOCS} GROUP BY e.id, e.name HAVING count(DISTINCT d.category) >= 3",
    "flight_people": f"SELECT e.name, count(DISTINCT d.id) AS n_docs FROM {_DOCS} WHERE e.type = 'person' AND (d.category = 'flight' OR d.title ILIKE '%flight%' OR d.filename ILIKE '%flight%') GROUP BY e.name",
    "flight_places": f"SELECT d.id, e.id AS entity_id, rank FROM (SELECT document_id, entity_id, row_number() OVER (PARTITION BY document_id ORDER BY count DESC, entity_id) AS rank FROM {{mentions}} WHERE entity_id IN (SELECT id FROM {{entities}} WHERE type = 'place')) m JOIN {{docs}} d ON d.id = m.document_id JOIN {{entities}} e ON e.id = m.entity_id WHERE d.category = 'flight' AND rank <= 5",
    "deposition_people": f"SELECT d.id, m.entity_id, m.rank FROM (SELECT document_id, entity_id, row_number() OVER (PARTITION BY document_id ORDER BY count DESC, entity_id) AS rank FROM {{mentions}} WHERE entity_id IN (SELECT id FROM {{entities}} WHERE type = 'person')) m JOIN {{docs}} d ON d.id = m.document_id WHERE d.category ILIKE 'deposition' AND m.rank <= 10",
    "contact_network": f"WITH c AS (SELECT id FROM {{docs}} WHERE category = 'correspondence' ORDER BY id LIMIT 500), p AS (SELECT m.document_id, e.id, e.name, row_number() OVER (PARTITION BY m.document_id ORDER BY m.count DESC, e.id) AS rank FROM {{mentions}} m JOIN c ON c.id = m.document_id JOIN {{entities}} e ON e.id = m.entity_id WHERE e.type = 'person') SELECT a.name AS name_a, b.name AS name_b, count(*) AS n FROM p a JOIN p b ON a.document_id = b.document_id AND a.name < b.name WHERE a.rank <= 5 AND b.rank <= 5 GROUP BY a.name, b.name",
    "entity_export_cooccurring": "SELECT e.id, e.name, l.weight FROM (SELECT entity_b_id AS id, weight FROM {links} WHERE entity_a_id = 7 UNION ALL SELECT entity_a_id, weight FROM {links} WHERE entity_b_id = 7) l JOIN {entities} e ON e.id = l.id ORDER BY l.weight DESC, e.id LIMIT 30",
    "entity_profile_risk": "SELECT avg(percent) AS mean_percent, count(*) AS n FROM (SELECT f.percent FROM {mentions} m JOIN {facts} f ON f.document_id = m.document_id WHERE m.entity_id = 7 AND f.analysis_type = 'risk_score' ORDER BY f.percent DESC, f.document_id LIMIT 10) x",
}
