"""Plans about documents, their texts, keywords and redactions."""

_FIELDS = "(CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN date <> '' THEN 1 ELSE 0 END + CASE WHEN source <> '' THEN 1 ELSE 0 END + CASE WHEN notes <> '' THEN 1 ELSE 0 END + CASE WHEN pages > 0 THEN 1 ELSE 0 END + CASE WHEN category <> 'other' THEN 1 ELSE 0 END + CASE WHEN flagged THEN 1 ELSE 0 END)"
_AGES = "CASE WHEN pages = 0 THEN '0' WHEN pages <= 2 THEN '1-2' WHEN pages <= 4 THEN '3-4' ELSE '5+' END"
_SIZES = "CASE WHEN n_chars < 1000 THEN '<1K' WHEN n_chars < 5000 THEN '1K-5K' WHEN n_chars < 20000 THEN '5K-20K' WHEN n_chars < 100000 THEN '20K-100K' ELSE '100K+' END"

PLANS = {
    "list_sources": "SELECT source, count(*) AS n_docs, CAST(sum(pages) AS BIGINT) AS pages FROM {docs} GROUP BY source",
    "keyword_cooccurrence": "WITH top AS (SELECT document_id, word FROM (SELECT document_id, word, row_number() OVER (PARTITION BY document_id ORDER BY count DESC, word) AS rank FROM {keywords}) r WHERE rank <= 50), k AS (SELECT document_id, word FROM top WHERE word IN (SELECT word FROM top GROUP BY word HAVING count(*) >= 5)) SELECT a.word AS word_a, b.word AS word_b, count(*) AS shared FROM k a JOIN k b ON a.document_id = b.document_id AND a.word < b.word GROUP BY a.word, b.word HAVING count(*) >= 3 ORDER BY shared DESC, word_a, word_b LIMIT 40",
    "get_stats": "SELECT (SELECT count(*) FROM {docs}) AS documents, (SELECT count(*) FROM {entities}) AS entities, (SELECT count(DISTINCT word) FROM {keywords}) AS keywords, (SELECT count(*) FROM {links}) AS connections",
    "stats_categories": "SELECT category, count(*) AS n FROM {docs} GROUP BY category",
    "dashboard_summary": "SELECT count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(CASE WHEN flagged THEN 1 ELSE 0 END) AS BIGINT) AS flagged, count(DISTINCT source) AS sources, min(date) AS first_date, max(date) AS last_date FROM {docs}",
    "dashboard_categories": "SELECT category, count(*) AS n, CAST(sum(pages) AS BIGINT) AS pages FROM {docs} GROUP BY category ORDER BY n DESC, category LIMIT 10",
    "dashboard_sources": "SELECT source, count(*) AS n FROM {docs} WHERE source <> '' GROUP BY source ORDER BY n DESC, source LIMIT 10",
    "dashboard_alerts": "SELECT d.id, d.title, f.percent FROM {docs} d JOIN {facts} f ON f.document_id = d.id WHERE f.analysis_type = 'risk_score' AND f.percent >= 70",
    "source_timeline": "SELECT source, substr(date, 1, 4) AS year, count(*) AS n FROM {docs} GROUP BY source, substr(date, 1, 4)",
    "flagged_hub": "SELECT d.id, d.title, count(m.entity_id) AS n_entities FROM {docs} d LEFT JOIN {mentions} m ON m.document_id = d.id WHERE d.flagged GROUP BY d.id, d.title",
    "flagged_summary": "SELECT category, CAST(sum(CASE WHEN flagged THEN 1 ELSE 0 END) AS BIGINT) AS flagged, count(*) AS total FROM {docs} GROUP BY category",
    "flagged_entities": "SELECT e.id, e.name, count(DISTINCT d.id) AS n FROM {docs} d JOIN {mentions} m ON m.document_id = d.id JOIN {entities} e ON e.id = m.entity_id WHERE d.flagged GROUP BY e.id, e.name ORDER BY n DESC, e.id LIMIT 20",
    "category_distribution": "SELECT category, count(*) AS n, CAST(sum(pages) AS BIGINT) AS pages, count(CASE WHEN flagged THEN 1 END) AS flagged, min(date) AS first_date, max(date) AS last_date FROM {docs} GROUP BY category",
    "category_top_entities": "WITH s AS (SELECT d.category, m.entity_id, sum(m.count) AS n FROM {docs} d JOIN {mentions} m ON m.document_id = d.id GROUP BY d.category, m.entity_id) SELECT category, entity_id, CAST(n AS BIGINT) AS mentions, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, entity_id) AS rank FROM s) x WHERE rank <= 5",
    "document_age": "SELECT substr(date, 1, 3) || '0' AS decade, substr(date, 1, 4) AS year, count(*) AS n FROM {docs} GROUP BY 1, 2",
    "document_completeness": f"SELECT {_FIELDS} AS fields, count(*) AS n FROM {{docs}} GROUP BY 1",
    "document_completeness_worst": f"SELECT id, {_FIELDS} AS fields FROM {{docs}} ORDER BY fields, id LIMIT 100",
    "source_quality": f"SELECT source, round(avg({_FIELDS} / CAST(7 AS DOUBLE)), 6) AS mean, min({_FIELDS}) AS least, max({_FIELDS}) AS most FROM {{docs}} GROUP BY source",
    "document_length": "SELECT category, round(avg(n_chars), 4) AS mean, min(n_chars) AS least, max(n_chars) AS most, CAST(sum(pages) AS BIGINT) AS pages FROM {docs} GROUP BY category",
    "text_length_distribution": f"SELECT {_SIZES} AS bucket, count(*) AS n FROM {{texts}} GROUP BY 1",
    "document_text_length": "SELECT id, n_chars FROM {texts} ORDER BY n_chars DESC, id LIMIT 100",
    "document_readability": "SELECT round(avg(n_chars), 6) AS mean, max(n_chars) AS most, min(n_chars) AS least FROM {texts}",
    "document_readability_top": "SELECT id, n_chars, WORDS(text) AS n_words, round(CAST(length(text) AS DOUBLE) / WORDS(text), 4) AS per_word FROM {texts} WHERE n_chars > 0 ORDER BY n_chars DESC, id LIMIT 100",
    "document_word_count": "SELECT id, CAST(sum(count) AS BIGINT) AS n_words, count(*) AS n_distinct FROM (SELECT document_id AS id, count FROM {keywords}) x GROUP BY id",
    "document_duplicates_hash": "SELECT file_hash, count(*) AS n, JOINED(filename) AS files FROM {docs} GROUP BY file_hash HAVING count(*) > 1",
    "document_duplicates_title": "SELECT title, count(*) AS n FROM {docs} GROUP BY title HAVING count(*) > 1",
    "document_duplicates_text": "SELECT min(id) AS first_id, count(*) AS n FROM {texts} GROUP BY text HAVING count(*) > 1",
    "hash_audit": "SELECT count(*) AS total, count(DISTINCT file_hash) AS distinct_hashes, count(CASE WHEN file_hash IS NULL OR file_hash = '' THEN 1 END) AS missing FROM {docs}",
    "category_timeline": "SELECT category, substr(date, 1, 7) AS month, count(*) AS n FROM {docs} GROUP BY category, substr(date, 1, 7)",
    "orphan_documents": "SELECT d.id, d.title FROM {docs} d WHERE NOT EXISTS (SELECT 1 FROM {mentions} m WHERE m.document_id = d.id)",
    "page_distribution": f"SELECT {_AGES} AS bucket, count(*) AS n, min(pages) AS least FROM {{docs}} GROUP BY 1",
    "document_size_buckets": f"SELECT {_AGES} AS bucket, count(*) AS n, CAST(sum(pages) AS BIGINT) AS pages FROM {{docs}} GROUP BY 1",
    "ingest_timeline": "SELECT ingest_day, count(*) AS n, JOINED(category) AS categories FROM {docs} GROUP BY ingest_day",
    "ingest_velocity": "SELECT ingest_day, ingest_hour, count(*) AS n, CAST(sum(pages) AS BIGINT) AS pages FROM {docs} GROUP BY ingest_day, ingest_hour",
    "document_shared_entities": "SELECT a.document_id AS doc_a, b.document_id AS doc_b, count(*) AS shared FROM {mentions} a JOIN {mentions} b ON a.entity_id = b.entity_id AND a.document_id < b.document_id GROUP BY a.document_id, b.document_id ORDER BY shared DESC, doc_a, doc_b LIMIT 100",
    "source_date_range": "SELECT source, min(date) AS first_date, max(date) AS last_date, count(*) AS n, CAST(sum(pages) AS BIGINT) AS pages FROM {docs} GROUP BY source",
    "category_stats": "SELECT d.category, count(*) AS doc_count, CAST(sum(d.pages) AS BIGINT) AS pages, count(DISTINCT m.entity_id) AS n_entities FROM {docs} d LEFT JOIN {mentions} m ON m.document_id = d.id GROUP BY d.category",
    "document_date_clusters": "SELECT substr(date, 1, 4) AS year, count(*) AS n, CAST(sum(pages) AS BIGINT) AS pages, count(DISTINCT source) AS sources FROM {docs} GROUP BY 1",
    "source_entity_density": "SELECT d.source, round(CAST(count(DISTINCT m.entity_id) AS DOUBLE) / count(DISTINCT d.id), 6) AS density FROM {docs} d LEFT JOIN {mentions} m ON m.document_id = d.id GROUP BY d.source",
    "doc_source_cluster": "SELECT d.source, count(DISTINCT d.id) AS n_docs, count(DISTINCT m.entity_id) AS n_entities FROM {docs} d LEFT JOIN {mentions} m ON m.document_id = d.id GROUP BY d.source",
    "source_network": "WITH se AS (SELECT DISTINCT d.source, m.entity_id FROM {docs} d JOIN {mentions} m ON m.document_id = d.id) SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared FROM se a JOIN se b ON a.entity_id = b.entity_id AND a.source < b.source GROUP BY a.source, b.source HAVING count(*) >= 5",
    "source_overlap_matrix": "WITH se AS (SELECT DISTINCT d.source, m.entity_id FROM {docs} d JOIN {mentions} m ON m.document_id = d.id) SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared FROM se a JOIN se b ON a.entity_id = b.entity_id GROUP BY a.source, b.source",
    "source_entity_overlap": "WITH se AS (SELECT DISTINCT d.source, m.entity_id FROM {docs} d JOIN {mentions} m ON m.document_id = d.id), n AS (SELECT source, count(*) AS n FROM se GROUP BY source) SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared, max(x.n) AS total_a, max(y.n) AS total_b FROM se a JOIN se b ON a.entity_id = b.entity_id AND a.source < b.source JOIN n x ON x.source = a.source JOIN n y ON y.source = b.source GROUP BY a.source, b.source",
    "fts_stats": "SELECT count(*) AS indexed, count(CASE WHEN n_chars > 0 THEN 1 END) AS with_text FROM {texts}",
    "document_notes": "SELECT count(*) AS total, count(CASE WHEN notes <> '' THEN 1 END) AS with_notes FROM {docs}",
    "document_notes_summary": "SELECT id, title, notes FROM {docs} WHERE notes <> '' ORDER BY ingest_day DESC, id LIMIT 50",
    "bulk_tag_suggestions": "SELECT notes AS tag_text, count(*) AS n FROM {docs} WHERE notes <> '' GROUP BY notes",
    "source_page_distribution": "SELECT source, CAST(sum(pages) AS BIGINT) AS pages, round(avg(pages), 6) AS mean, min(pages) AS least, max(pages) AS most FROM {docs} GROUP BY source",
    "source_completeness": "SELECT d.source, count(DISTINCT d.id) AS n_docs, count(DISTINCT m.entity_id) AS n_entities, count(DISTINCT e.id) AS n_events, CAST(sum(d.pages) AS BIGINT) AS pages FROM {docs} d LEFT JOIN {mentions} m ON m.document_id = d.id LEFT JOIN {dated} e ON e.document_id = d.id GROUP BY d.source",
    "page_density": "WITH p AS (SELECT d.id, CAST(count(DISTINCT m.entity_id) AS DOUBLE) / d.pages AS density FROM {docs} d JOIN {mentions} m ON m.document_id = d.id WHERE d.pages > 0 GROUP BY d.id, d.pages) SELECT count(*) AS n, round(avg(density), 4) AS mean, max(density) AS most FROM p",
    "category_ingest_timeline": "SELECT ingest_day, category, count(*) AS n FROM {docs} GROUP BY ingest_day, category",
    "document_source_timeline": "SELECT ingest_day, source, count(*) AS n FROM {docs} GROUP BY ingest_day, source",
    "document_flagged_ratio": "SELECT source, count(CASE WHEN flagged THEN 1 END) AS flagged, count(CASE WHEN NOT flagged THEN 1 END) AS unflagged, round(CAST(100 AS DOUBLE) * count(CASE WHEN flagged THEN 1 END) / count(*), 4) AS percent FROM {docs} GROUP BY source",
    "source_ingestion_summary": "SELECT source, count(*) AS n, min(ingest_day) AS first_day, max(ingest_day) AS last_day, CAST(sum(pages) AS BIGINT) AS pages FROM {docs} GROUP BY source",
    "page_text_coverage": "SELECT source, count(CASE WHEN n_chars > 0 THEN 1 END) AS with_text, count(CASE WHEN n_chars = 0 THEN 1 END) AS without_text FROM {texts} GROUP BY source",
    "source_category_matrix": "SELECT source, category, count(*) AS n FROM {docs} GROUP BY source, category",
    "source_document_quality": "SELECT source, round(avg(pages), 6) AS mean_pages, round(CAST(100 AS DOUBLE) * count(CASE WHEN date IS NOT NULL THEN 1 END) / count(*), 4) AS dated FROM {docs} GROUP BY source",
    "document_category_balance": "SELECT category, n, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (), 4) AS percent FROM (SELECT category, CAST(count(*) AS DOUBLE) AS n FROM {docs} GROUP BY category) x",
    "document_title_analysis": "SELECT CAST(min(length(title)) AS BIGINT) AS least, CAST(max(length(title)) AS BIGINT) AS most, round(avg(length(title)), 6) AS mean, count(CASE WHEN title = '' THEN 1 END) AS missing FROM {docs}",
    "document_filename_pattern": "SELECT substr(filename, length(filename) - 3) AS extension, count(*) AS n FROM {docs} GROUP BY 1",
    "document_ingestion_gap": "SELECT day, before, DAYS(before, day) AS days, n FROM (SELECT ingest_day AS day, n, lag(ingest_day) OVER (ORDER BY ingest_day) AS before FROM (SELECT ingest_day, count(*) AS n FROM {docs} GROUP BY ingest_day) x) y WHERE before IS NOT NULL",
    "document_source_diversity": "SELECT category, count(DISTINCT source) AS n_sources FROM {docs} GROUP BY category",
    "document_page_outliers": "SELECT id, pages FROM {docs} WHERE pages > 1.6 * (SELECT avg(pages) FROM {docs} WHERE pages > 0)",
    "document_flagged_timeline": "SELECT substr(date, 1, 7) AS month, count(*) AS n FROM {docs} WHERE flagged GROUP BY 1",
    "document_gaps": "SELECT date, before, DAYS(before, date) AS days FROM (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM {docs} WHERE source = 'NATION_6') x) y WHERE DAYS(before, date) >= 10",
    "document_gap_years": "SELECT substr(date, 1, 4) AS year, count(*) AS n, count(DISTINCT substr(date, 1, 7)) AS months FROM {docs} GROUP BY 1",
    "ocr_quality_overview": "SELECT grade, count(*) AS n FROM (SELECT CASE WHEN per_page >= 8000 THEN 'good' WHEN per_page >= 4000 THEN 'fair' WHEN per_page >= 1500 THEN 'poor' ELSE 'very_poor' END AS grade FROM (SELECT floor(n_chars / pages) AS per_page FROM {docs} WHERE pages > 0) x) y GROUP BY grade",
    "export_documents": "SELECT d.id, d.title, d.category, d.source, count(DISTINCT m.entity_id) AS entity_count FROM {docs} d LEFT JOIN {mentions} m ON m.document_id = d.id GROUP BY d.id, d.title, d.category, d.source ORDER BY entity_count DESC, d.id LIMIT 500",
    "source_credibility": "SELECT s.source, s.n, r.rating FROM (SELECT source, count(*) AS n FROM {docs} GROUP BY source) s LEFT JOIN {ratings} r ON r.source = s.source",
    "source_credibility_overlap": "WITH se AS (SELECT DISTINCT d.source, m.entity_id FROM {docs} d JOIN {mentions} m ON m.document_id = d.id) SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared, max(x.rating) AS rating_a, max(y.rating) AS rating_b FROM se a JOIN se b ON a.entity_id = b.entity_id AND a.source < b.source LEFT JOIN {ratings} x ON x.source = a.source LEFT JOIN {ratings} y ON y.source = b.source GROUP BY a.source, b.source ORDER BY shared DESC, source_a, source_b LIMIT 20",
    "keyword_alerts": "WITH k AS (SELECT 'tion' AS keyword UNION ALL SELECT 'password'), h AS (SELECT k.keyword, t.id, CAST(floor((length(t.text) - length(replace(t.text, k.keyword, ''))) / length(k.keyword)) AS BIGINT) AS hits FROM {texts} t JOIN k ON contains(t.text, k.keyword)) SELECT keyword, id, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY hits DESC, id) AS rank FROM h) x WHERE rank <= 20",
    "redaction_analysis": "SELECT d.category, r.reason, count(*) AS n, CAST(sum(r.end_offset - r.start_offset) AS BIGINT) AS chars FROM {redactions} r JOIN {docs} d ON d.id = r.document_id GROUP BY d.category, r.reason",
    "redaction_density": "SELECT d.id, count(r.document_id) AS n, round(CAST(1000 AS DOUBLE) * count(r.document_id) / d.n_chars, 4) AS per_1000 FROM {docs} d JOIN {redactions} r ON r.document_id = d.id WHERE d.n_chars > 0 GROUP BY d.id, d.n_chars",
    "redaction_by_source": "SELECT d.source, count(r.document_id) AS n, count(DISTINCT r.document_id) AS redacted, count(DISTINCT d.id) AS total FROM {docs} d LEFT JOIN {redactions} r ON r.document_id = d.id GROUP BY d.source",
    "redaction_patterns": "SELECT CASE WHEN end_offset - start_offset < 50 THEN 'small' WHEN end_offset - start_offset < 200 THEN 'medium' ELSE 'large' END AS size, reason, count(*) AS n FROM {redactions} GROUP BY 1, 2",
    "redaction_density_ranking": "SELECT d.id, round(CAST(count(*) AS DOUBLE) / d.pages, 4) AS per_page FROM {redactions} r JOIN {docs} d ON d.id = r.document_id WHERE d.pages > 0 GROUP BY d.id, d.pages",
    "redaction_timeline": "SELECT d.ingest_day, count(*) AS n FROM {redactions} r JOIN {docs} d ON d.id = r.document_id GROUP BY d.ingest_day",
    "redaction_document_coverage": "SELECT count(DISTINCT d.id) AS total, count(DISTINCT r.document_id) AS redacted FROM {docs} d LEFT JOIN {redactions} r ON r.document_id = d.id",
    "duplicate_documents": "SELECT file_hash, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM {docs} GROUP BY file_hash HAVING count(*) > 1",
}
