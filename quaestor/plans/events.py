"""Plans about dated events, connections, findings and money."""

_DAY = "length(event_date) >= 10"
_ENDS = "(SELECT entity_a_id AS id, entity_b_id AS partner, weight FROM {links} UNION ALL SELECT entity_b_id, entity_a_id, weight FROM {links}) x"
_TIER = "CASE WHEN weight >= 100 THEN '100+' WHEN weight >= 50 THEN '50-99' WHEN weight >= 20 THEN '20-49' WHEN weight >= 5 THEN '5-19' WHEN weight >= 2 THEN '2-4' ELSE '1' END"
_SURE = "CASE WHEN confidence >= 0.9 THEN 'very high' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'very low' END"
_RISK = "CASE WHEN percent >= 80 THEN 'critical' WHEN percent >= 60 THEN 'high' WHEN percent >= 40 THEN 'medium' WHEN percent >= 20 THEN 'low' ELSE 'minimal' END"
_EE = "{entities} e JOIN {event_entities} x ON x.entity_id = e.id JOIN {dated} v ON v.id = x.event_id"

PLANS = {
    "timeline_heatmap": f"SELECT event_date, count(*) AS n FROM {{dated}} WHERE {_DAY} AND confidence >= 0.5 AND event_date BETWEEN '1980' AND '2026' GROUP BY event_date",
    "activity_heatmap": f"SELECT day, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_date AS day, count(*) AS n FROM {{dated}} WHERE {_DAY} GROUP BY event_date UNION ALL SELECT date, count(*) FROM {{docs}} GROUP BY date) x GROUP BY day",
    "key_dates": f"SELECT event_date, count(*) AS n, count(DISTINCT document_id) AS n_docs, JOINED(context) AS contexts FROM {{dated}} WHERE {_DAY} GROUP BY event_date ORDER BY n DESC, event_date LIMIT 50",
    "temporal_heatmap": "SELECT substr(event_date, 1, 4) AS year, substr(event_date, 6, 2) AS month, count(*) AS n FROM {dated} WHERE length(event_date) >= 7 GROUP BY 1, 2",
    "entity_timeline_density": f"SELECT e.id, e.name, count(DISTINCT v.event_date) AS n_dates, count(DISTINCT v.id) AS n_events, min(v.event_date) AS first_date, max(v.event_date) AS last_date FROM {_EE} GROUP BY e.id, e.name",
    "event_calendar": f"SELECT event_date, count(*) AS n FROM {{dated}} WHERE {_DAY} AND event_date LIKE '1997%' GROUP BY event_date",
    "timeline_gaps": f"SELECT before, event_date, DAYS(before, event_date) AS days FROM (SELECT event_date, lag(event_date) OVER (ORDER BY event_date) AS before FROM (SELECT DISTINCT event_date FROM {{dated}} WHERE {_DAY}) x) y WHERE DAYS(before, event_date) >= 2",
    "event_entity_ranking": f"SELECT e.id, e.name, e.type, count(DISTINCT v.id) AS n, min(v.event_date) AS first_date, max(v.event_date) AS last_date FROM {_EE} GROUP BY e.id, e.name, e.type",
    "event_types_precision": "SELECT precision, count(*) AS n FROM {dated} GROUP BY precision",
    "event_types_confidence": f"SELECT {_SURE} AS bucket, count(*) AS n, min(confidence) AS least FROM {{dated}} GROUP BY 1",
    "event_types_resolved": "SELECT count(CASE WHEN is_resolved THEN 1 END) AS resolved, count(CASE WHEN NOT is_resolved THEN 1 END) AS unresolved FROM {dated}",
    "event_context": "SELECT context, count(*) AS n FROM {dated} GROUP BY context ORDER BY n DESC, context LIMIT 50",
    "event_heatmap": "SELECT CAST(substr(event_date, 1, 4) AS BIGINT) AS year, substr(event_date, 6, 2) AS month, count(*) AS n FROM {dated} WHERE length(event_date) >= 7 AND CAST(substr(event_date, 1, 4) AS BIGINT) BETWEEN 1950 AND 2030 GROUP BY 1, 2",
    "event_resolution_rate": "SELECT d.source, count(CASE WHEN v.is_resolved THEN 1 END) AS resolved, count(*) AS total, round(CAST(100 AS DOUBLE) * count(CASE WHEN v.is_resolved THEN 1 END) / count(*), 4) AS percent FROM {dated} v JOIN {docs} d ON d.id = v.document_id GROUP BY d.source",
    "event_confidence_ranking": "SELECT id, event_date, confidence FROM {dated} ORDER BY confidence, id LIMIT 100",
    "orphan_events": "SELECT v.id, v.document_id, v.event_date FROM {dated} v WHERE v.document_id NOT IN (SELECT document_id FROM {mentions})",
    "event_precision_stats": "SELECT precision, is_resolved, count(*) AS n FROM {dated} GROUP BY precision, is_resolved",
    "event_date_gaps": f"SELECT id, event_date, DAYS(before, event_date) AS days FROM (SELECT id, event_date, lag(event_date) OVER (ORDER BY event_date) AS before FROM (SELECT min(id) AS id, event_date FROM {{dated}} WHERE {_DAY} GROUP BY event_date) x) y WHERE before IS NOT NULL ORDER BY days DESC, event_date, id LIMIT 50",
    "entity_longevity": f"SELECT e.id, e.name, count(DISTINCT v.id) AS n, DAYS(min(v.event_date), max(v.event_date)) AS span_days FROM {_EE} WHERE length(v.event_date) >= 10 GROUP BY e.id, e.name HAVING count(DISTINCT v.id) > 1",
    "entity_lifecycle_span": f"SELECT e.id, DAYS(min(v.event_date), max(v.event_date)) AS span_days, count(DISTINCT v.event_date) AS n_dates FROM {_EE} WHERE length(v.event_date) >= 10 GROUP BY e.id HAVING count(DISTINCT v.event_date) >= 2",
    "event_cluster_density": "SELECT substr(event_date, 1, 7) AS month, count(*) AS n FROM {dated} WHERE length(event_date) >= 7 AND substr(event_date, 1, 4) BETWEEN '1900' AND '2100' GROUP BY 1 ORDER BY n DESC, month LIMIT 50",
    "event_date_quality": "SELECT count(*) AS total, count(event_date) AS with_date, count(CASE WHEN substr(event_date, 1, 4) BETWEEN '1900' AND '2100' THEN 1 END) AS in_range FROM {dated}",
    "event_source_density": "SELECT d.source, count(v.id) AS n_events, count(DISTINCT d.id) AS n_docs, round(CAST(count(v.id) AS DOUBLE) / count(DISTINCT d.id), 6) AS per_doc FROM {docs} d LEFT JOIN {dated} v ON v.document_id = d.id GROUP BY d.source",
    "event_confidence_distribution": f"SELECT bucket, n, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (), 4) AS percent FROM (SELECT {_SURE} AS bucket, CAST(count(*) AS DOUBLE) AS n FROM {{dated}} GROUP BY 1) x",
    "source_date_span": "SELECT d.source, min(v.event_date) AS first_date, max(v.event_date) AS last_date FROM {dated} v JOIN {docs} d ON d.id = v.document_id WHERE v.event_date IS NOT NULL GROUP BY d.source",
    "event_temporal_density": "SELECT substr(event_date, 1, 4) AS year, count(*) AS n FROM {dated} WHERE MATCHES(event_date, '^[0-9]{4}') GROUP BY 1",
    "event_context_length": "SELECT CAST(min(length(context)) AS BIGINT) AS least, CAST(max(length(context)) AS BIGINT) AS most, round(avg(length(context)), 6) AS mean FROM {dated}",
    "event_date_range_span": "SELECT substr(context, 1, 6) AS grp, min(event_date) AS first_date, max(event_date) AS last_date, count(*) AS n FROM {dated} GROUP BY 1 HAVING count(*) >= 2",
    "event_monthly_heatmap": "SELECT substr(event_date, 1, 7) AS month, count(*) AS n FROM {dated} WHERE length(event_date) >= 7 AND MATCHES(event_date, '^[0-9]{4}') GROUP BY 1",
    "event_weekday_distribution": f"SELECT WEEKDAY(event_date) AS weekday, count(*) AS n FROM {{dated}} WHERE {_DAY} GROUP BY 1",
    "event_burst_detection": "WITH m AS (SELECT substr(event_date, 1, 7) AS month, count(*) AS n FROM {dated} WHERE length(event_date) >= 7 GROUP BY 1) SELECT month, n FROM m WHERE n > 1.05 * (SELECT avg(n) FROM m)",
    "event_confidence_trend": "SELECT substr(event_date, 1, 7) AS month, round(avg(confidence), 3) AS mean FROM {dated} WHERE length(event_date) >= 7 GROUP BY 1",
    "event_precision_histogram": "SELECT coalesce(precision, 'unknown') AS precision, count(*) AS n FROM {dated} GROUP BY 1",
    "timeline_stats": "SELECT count(*) AS total, count(CASE WHEN NOT is_resolved THEN 1 END) AS unresolved, min(event_date) AS first_date, max(event_date) AS last_date FROM {dated}",
    "get_timeline": "SELECT v.id, v.event_date, v.precision, v.confidence FROM {dated} v WHERE v.is_resolved AND v.confidence >= 0.5 AND v.event_date BETWEEN '1996' AND '1997-06' AND v.id IN (SELECT x.event_id FROM {event_entities} x JOIN {entities} e ON e.id = x.entity_id WHERE e.name ILIKE '%blue%') ORDER BY v.event_date, v.id LIMIT 200",
    "export_timeline": "SELECT v.id, v.event_date, v.confidence, d.title FROM {dated} v JOIN {docs} d ON d.id = v.document_id WHERE v.event_date IS NOT NULL AND v.confidence >= 0.5 ORDER BY v.event_date, v.id LIMIT 1000",
    "visualization_timeline": "SELECT substr(v.event_date, 1, 7) AS month, count(*) AS n, max(f.percent) AS most_risk FROM {dated} v LEFT JOIN (SELECT document_id, max(percent) AS percent FROM {facts} GROUP BY document_id) f ON f.document_id = v.document_id WHERE v.confidence >= 0.5 AND length(v.event_date) >= 7 GROUP BY 1",
    "entity_connections_map": "SELECT CASE WHEN l.entity_a_id = 7 THEN l.entity_b_id ELSE l.entity_a_id END AS other, l.weight FROM {links} l WHERE l.entity_a_id = 7 OR l.entity_b_id = 7",
    "relationship_matrix": "WITH top AS (SELECT e.id, sum(m.count) AS n FROM {entities} e JOIN {mentions} m ON m.entity_id = e.id WHERE e.type = 'person' GROUP BY e.id ORDER BY n DESC, e.id LIMIT 30) SELECT l.entity_a_id, l.entity_b_id, l.weight FROM {links} l WHERE l.entity_a_id IN (SELECT id FROM top) AND l.entity_b_id IN (SELECT id FROM top)",
    "relationship_graph": "SELECT l.entity_a_id, l.entity_b_id, l.weight FROM {links} l JOIN {entities} a ON a.id = l.entity_a_id JOIN {entities} b ON b.id = l.entity_b_id WHERE a.type = 'org' AND b.type = 'org' AND l.weight >= 1 ORDER BY l.weight DESC, l.entity_a_id, l.entity_b_id LIMIT 100",
    "connection_strength": "SELECT l.entity_a_id, l.entity_b_id, l.weight FROM {links} l JOIN {entities} a ON a.id = l.entity_a_id WHERE a.type = 'person' ORDER BY l.weight DESC, 1, 2 LIMIT 50",
    "top_connections": "SELECT entity_a_id, entity_b_id, weight FROM {links} ORDER BY weight DESC, entity_a_id, entity_b_id LIMIT 100",
    "export_entity_graph": "WITH n AS (SELECT e.id, coalesce(sum(m.count), 0) AS mentions FROM {entities} e LEFT JOIN {mentions} m ON m.entity_id = e.id GROUP BY e.id ORDER BY mentions DESC, e.id LIMIT 500) SELECT l.entity_a_id, l.entity_b_id, l.weight FROM {links} l WHERE l.entity_a_id IN (SELECT id FROM n) AND l.entity_b_id IN (SELECT id FROM n)",
    "link_analysis": f"WITH ends AS (SELECT id, partner, weight FROM {_ENDS} WHERE weight >= 2), d AS (SELECT id, CAST(sum(weight) AS BIGINT) AS degree, count(DISTINCT partner) AS partners FROM ends GROUP BY id) SELECT id, degree, partners, round(CAST(degree AS DOUBLE) / (SELECT max(degree) FROM d), 6) AS share FROM d",
    "entity_degree_distribution": f"SELECT CASE WHEN n < 50 THEN '<50' WHEN n < 100 THEN '50-99' WHEN n < 150 THEN '100-149' ELSE '150+' END AS bucket, count(*) AS entities, round(avg(n), 6) AS mean FROM (SELECT id, count(*) AS n FROM {_ENDS} GROUP BY id) y GROUP BY 1",
    "entity_hub_score": f"SELECT id, count(*) AS degree FROM {_ENDS} GROUP BY id ORDER BY degree DESC, id LIMIT 100",
    "entity_degree_centrality": f"SELECT id, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weight FROM {_ENDS} GROUP BY id",
    "entity_betweenness_score": f"SELECT id, count(DISTINCT partner) AS partners FROM {_ENDS} GROUP BY id",
    "entity_connection_density": f"SELECT id, count(*) AS edges, count(DISTINCT partner) AS partners, round(avg(weight), 6) AS mean FROM {_ENDS} GROUP BY id",
    "connection_bridge_entities": f"SELECT id, count(DISTINCT partner) AS partners, CAST(sum(weight) AS BIGINT) AS weight FROM {_ENDS} GROUP BY id HAVING count(DISTINCT partner) >= 3",
    "connection_asymmetry": f"SELECT id, min(weight) AS least, max(weight) AS most, round(avg(weight), 6) AS mean, max(weight) - min(weight) AS spread FROM {_ENDS} GROUP BY id HAVING count(*) >= 3",
    "entity_connection_strength_rank": f"SELECT id, partner, weight FROM (SELECT id, partner, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, partner) AS rank FROM {_ENDS}) y WHERE rank = 1",
    "entity_isolation": f"SELECT e.id, e.name, coalesce(c.n, 0) AS connections, coalesce(m.n, 0) AS docs FROM {{entities}} e LEFT JOIN (SELECT id, count(*) AS n FROM {_ENDS} GROUP BY id) c ON c.id = e.id LEFT JOIN (SELECT entity_id, count(*) AS n FROM {{mentions}} GROUP BY entity_id) m ON m.entity_id = e.id WHERE coalesce(c.n, 0) <= 60",
    "entity_isolation_score": f"SELECT count(*) AS isolated FROM {{entities}} e WHERE NOT EXISTS (SELECT 1 FROM {{links}} l WHERE l.entity_a_id = e.id) AND NOT EXISTS (SELECT 1 FROM {{links}} l WHERE l.entity_b_id = e.id)",
    "connection_weight_distribution": "SELECT weight, count(*) AS n FROM {links} GROUP BY weight",
    "connection_weight_stats": "SELECT count(*) AS n, round(avg(weight), 6) AS mean, max(weight) AS most, min(weight) AS least, CAST(sum(weight) AS BIGINT) AS total FROM {links}",
    "connection_cluster_summary": f"SELECT {_TIER} AS tier, count(*) AS n, round(avg(weight), 6) AS mean FROM {{links}} GROUP BY 1",
    # rows are ranked through the histogram of weights, so that no window runs over all edges
    "connection_weight_percentile": "WITH h AS (SELECT weight, count(*) AS c FROM {links} GROUP BY weight), r AS (SELECT weight, c, CAST(sum(c) OVER (ORDER BY weight) AS BIGINT) AS top FROM h), t AS (SELECT CAST(sum(c) AS BIGINT) AS n FROM h), k AS (SELECT 1 AS slice, CAST(0 AS BIGINT) AS low, CAST(floor(n / 4) AS BIGINT) AS high FROM t UNION ALL SELECT 2, CAST(floor(n / 4) AS BIGINT), CAST(floor(n / 2) AS BIGINT) FROM t UNION ALL SELECT 3, CAST(floor(n / 2) AS BIGINT), CAST(floor(3 * n / 4) AS BIGINT) FROM t UNION ALL SELECT 4, CAST(floor(3 * n / 4) AS BIGINT), n FROM t) SELECT slice, CAST(sum(least(top, high) - greatest(top - c, low)) AS BIGINT) AS n, min(weight) AS least, max(weight) AS most, round(CAST(sum(weight * (least(top, high) - greatest(top - c, low))) AS DOUBLE) / sum(least(top, high) - greatest(top - c, low)), 6) AS mean FROM k JOIN r ON top > low AND top - c < high GROUP BY slice",
    "connection_density": "SELECT a.type AS type_a, b.type AS type_b, count(*) AS n, CAST(sum(l.weight) AS BIGINT) AS weight FROM {links} l JOIN {entities} a ON a.id = l.entity_a_id JOIN {entities} b ON b.id = l.entity_b_id GROUP BY a.type, b.type",
    "connection_type_breakdown": "SELECT a.type AS type_a, b.type AS type_b, count(*) AS n, round(avg(l.weight), 2) AS mean FROM {links} l JOIN {entities} a ON a.id = l.entity_a_id JOIN {entities} b ON b.id = l.entity_b_id GROUP BY a.type, b.type",
    "entity_cross_type_connections": "SELECT count(CASE WHEN a.type <> b.type THEN 1 END) AS across, count(CASE WHEN a.type = b.type THEN 1 END) AS within FROM {links} l JOIN {entities} a ON a.id = l.entity_a_id JOIN {entities} b ON b.id = l.entity_b_id",
    "connection_reciprocity": "SELECT count(*) AS reciprocal FROM {links} l WHERE EXISTS (SELECT 1 FROM {links} r WHERE r.entity_a_id = l.entity_b_id AND r.entity_b_id = l.entity_a_id)",
    "entity_pair_strength": "WITH n AS (SELECT entity_id, count(*) AS docs FROM {mentions} GROUP BY entity_id) SELECT l.entity_a_id, l.entity_b_id, l.weight, x.docs AS docs_a, y.docs AS docs_b FROM {links} l JOIN n x ON x.entity_id = l.entity_a_id JOIN n y ON y.entity_id = l.entity_b_id ORDER BY l.weight DESC, 1, 2 LIMIT 100",
    "connection_growth_timeline": "SELECT substr(d.date, 1, 7) AS month, count(*) AS pairs FROM (SELECT DISTINCT x.entity_id AS a, y.entity_id AS b, substr(d.date, 1, 7) AS month, 1 AS one FROM {mentions} x JOIN {mentions} y ON x.document_id = y.document_id AND x.entity_id < y.entity_id JOIN {docs} d ON d.id = x.document_id) p JOIN (SELECT DISTINCT substr(date, 1, 7) AS m, substr(date, 1, 7) || '-01' AS date FROM {docs}) d ON d.m = p.month GROUP BY 1",
    "connection_temporal_overlap": "SELECT x.entity_id AS a, y.entity_id AS b, count(DISTINCT substr(d.date, 1, 7)) AS months, min(d.date) AS first_date, max(d.date) AS last_date FROM {mentions} x JOIN {mentions} y ON x.document_id = y.document_id AND x.entity_id < y.entity_id JOIN {docs} d ON d.id = x.document_id GROUP BY 1, 2 HAVING count(DISTINCT substr(d.date, 1, 7)) >= 2",
    "forensics_summary_topics": "SELECT label, count(*) AS n, round(avg(percent), 6) AS mean FROM {facts} WHERE analysis_type = 'topic' GROUP BY label",
    "forensics_summary_aml": "SELECT label, severity, count(*) AS n FROM {facts} WHERE analysis_type = 'aml_flag' GROUP BY label, severity",
    "forensics_summary_risk": f"SELECT {_RISK} AS level, count(*) AS n FROM {{facts}} WHERE analysis_type = 'risk_score' GROUP BY 1",
    "forensics_risk_documents": "SELECT d.id, d.title, f.percent FROM {facts} f JOIN {docs} d ON d.id = f.document_id WHERE f.analysis_type = 'risk_score' ORDER BY f.percent DESC, d.id LIMIT 20",
    "forensics_codewords": "SELECT label, count(DISTINCT document_id) AS n FROM {facts} WHERE analysis_type = 'codeword' GROUP BY label",
    "forensics_harvest": "SELECT d.id, d.title, f.percent, a.n AS flags, i.n AS indicators FROM {docs} d JOIN {facts} f ON f.document_id = d.id AND f.analysis_type = 'risk_score' AND f.percent >= 50 LEFT JOIN (SELECT document_id, count(*) AS n FROM {facts} WHERE analysis_type = 'aml_flag' GROUP BY document_id) a ON a.document_id = d.id LEFT JOIN (SELECT document_id, count(*) AS n FROM {indicators} GROUP BY document_id) i ON i.document_id = d.id",
    "intel_brief_persons": "SELECT e.id, e.name, count(DISTINCT m.document_id) AS n FROM {mentions} m JOIN {entities} e ON e.id = m.entity_id WHERE e.type = 'person' AND m.document_id IN (SELECT document_id FROM {facts} WHERE analysis_type = 'risk_score' AND percent >= 50) GROUP BY e.id, e.name ORDER BY n DESC, e.id LIMIT 30",
    "risk_dashboard_source": "SELECT d.source, round(avg(f.percent), 6) AS mean, max(f.percent) AS most, count(*) AS n FROM {facts} f JOIN {docs} d ON d.id = f.document_id WHERE f.analysis_type = 'risk_score' GROUP BY d.source",
    "risk_dashboard_category": "SELECT d.category, round(avg(f.percent), 6) AS mean, count(*) AS n FROM {facts} f JOIN {docs} d ON d.id = f.document_id WHERE f.analysis_type = 'risk_score' GROUP BY d.category",
    "anomaly_date_spikes": "WITH c AS (SELECT date, count(*) AS n FROM {docs} GROUP BY date), m AS (SELECT avg(n) AS mean FROM c) SELECT c.date, c.n FROM c CROSS JOIN m WHERE c.n >= greatest(1.5 * m.mean, 5) ORDER BY c.n DESC, c.date LIMIT 20",
    "anomaly_edge_ratio": "WITH n AS (SELECT entity_id, count(*) AS docs FROM {mentions} GROUP BY entity_id) SELECT l.entity_a_id, l.entity_b_id, round(CAST(l.weight AS DOUBLE) / (x.docs + y.docs), 6) AS ratio FROM {links} l JOIN n x ON x.entity_id = l.entity_a_id JOIN n y ON y.entity_id = l.entity_b_id WHERE l.weight >= 3 ORDER BY ratio DESC, 1, 2 LIMIT 20",
    "anomaly_concentrated": "SELECT entity_id, CAST(sum(count) AS BIGINT) AS mentions, count(*) AS docs FROM {mentions} GROUP BY entity_id HAVING sum(count) >= 10 AND count(*) <= 12",
    "forensics_financial": "SELECT document_id, indicator_type, value, risk FROM {indicators} ORDER BY risk DESC, document_id, value LIMIT 50",
    "financial_types": "SELECT indicator_type, count(*) AS n, round(avg(risk), 2) AS mean, max(risk) AS most FROM {indicators} GROUP BY indicator_type",
    "financial_profiles": "SELECT e.id, e.name, count(DISTINCT i.value) AS n_values, round(avg(i.risk), 6) AS mean, max(i.risk) AS most, JOINED(i.indicator_type) AS types FROM {entities} e JOIN {mentions} m ON m.entity_id = e.id JOIN {indicators} i ON i.document_id = m.document_id GROUP BY e.id, e.name HAVING count(DISTINCT i.value) >= 2",
    "financial_entity_links": "SELECT e.id, e.name, count(DISTINCT i.value) AS n_values, CAST(sum(i.risk) AS BIGINT) AS risk, count(DISTINCT m.document_id) AS docs FROM {entities} e JOIN {mentions} m ON m.entity_id = e.id JOIN {indicators} i ON i.document_id = m.document_id GROUP BY e.id, e.name ORDER BY risk DESC, e.id LIMIT 50",
    "financial_trail_persons": "SELECT e.id, count(*) AS n FROM {entities} e JOIN {mentions} m ON m.entity_id = e.id JOIN {indicators} i ON i.document_id = m.document_id WHERE e.type = 'person' GROUP BY e.id ORDER BY n DESC, e.id LIMIT 50",
    "investigation_stats": "SELECT (SELECT count(*) FROM {docs}) AS docs, (SELECT count(*) FROM {dated}) AS events, (SELECT count(*) FROM {indicators}) AS indicators, (SELECT count(*) FROM {aliases}) AS aliases, (SELECT count(*) FROM {redactions}) AS redactions",
    "investigation_timeline": "SELECT kind, day, id FROM (SELECT * FROM (SELECT 'ingest' AS kind, ingest_day AS day, id FROM {docs} ORDER BY ingest_day DESC, id LIMIT 50) a UNION ALL SELECT * FROM (SELECT 'event' AS kind, event_date AS day, id FROM {dated} WHERE length(event_date) >= 10 ORDER BY event_date DESC, id LIMIT 30) b) x ORDER BY day DESC, kind, id LIMIT 100",
}
