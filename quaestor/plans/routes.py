"""Routes and text functions bound to constants, each with a statement of its own for the oracle, written apart from the route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor import api
from quaestor.bindings import Corpus
from quaestor.functions import phrases
from quaestor.operators import graph, pairs
from quaestor.plans import documents, entities, events, more

_DOC = "id, filename, title, category, source, date, pages, flagged"
_MENTIONED = "SELECT entity_id, count(DISTINCT document_id) AS doc_count, CAST(sum(count) AS BIGINT) AS mentions FROM {mentions} GROUP BY entity_id"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_STOPS, _PHRASE_STOPS = _list(phrases.STOP_WORDS), _list(phrases.L.PHRASE_STOPS)


def _texts(c: Corpus) -> DataFrame:
    """The samples, and the documents under names of their own."""
    return c["samples"].select("id", "filename", "text").unionByName(c["texts"].select((F.col("id") + 1000).alias("id"), F.concat(F.lit("scan_no-"), "id", F.lit(".pdf")).alias("filename"), "text"))


_TEXTS = "SELECT id, filename, text FROM {samples} UNION ALL SELECT id + 1000, 'scan_no-' || id || '.pdf', text FROM {texts}"
#: Repeated phrases of each text, from word runs numbered as they come.
_PHRASES = f"""ws AS (SELECT id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}')) AS ws FROM {{texts}}),
    runs AS (SELECT id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS phrase FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM ws, (SELECT unnest([3, 4, 5]) AS n))),
    counted AS (SELECT id, n, phrase, count(*) AS count, min(p) AS p FROM runs GROUP BY ALL HAVING count(*) >= 2),
    seen AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, n, p) AS place FROM counted),
    told AS (SELECT * FROM seen WHERE place <= 200 AND len(list_filter(string_split(phrase, ' '), lambda w: NOT list_contains({_PHRASE_STOPS}, w))) >= 2),
    ranked AS (SELECT id, phrase, count, row_number() OVER (PARTITION BY id ORDER BY place) AS rank FROM told)"""


def _advanced(c: Corpus) -> DataFrame:
    found = api.advanced_search(c, category="report", date_from="1996-01-01", date_to="1998-12-31", entity_name="blue", min_risk=50, limit=None)
    return found.select("id", "title", "category", "source", "date")


def _same_day(c: Corpus) -> DataFrame:
    """Pairs of entities, the first a person, on three days or more."""
    days = c["mentions"].join(c["docs"].select(F.col("id").alias("document_id"), F.unix_date(F.try_to_date("date", "yyyy-MM-dd")).alias("date")), "document_id")
    return pairs.sharing_in_blocks(days, "entity_id", "date", 3, first=c["entities"].filter("type = 'person'").select("id")).toDF("id_a", "id_b", "days")


def _keyword_pairs(c: Corpus) -> DataFrame:
    """Pairs of words that most documents have among their fifty commonest."""
    top = pairs.top_per_group(c["keywords"], ["document_id"], [F.col("count").desc(), F.col("word")], 50)
    return pairs.most_shared(graph.cut(top.select("document_id", "word")), "document_id", "word", 40, 3, 5).toDF("word_a", "word_b", "shared")


def _financial(c: Corpus) -> DataFrame:
    """Entities of the riskiest documents by indicators."""
    n = c.tasks()
    c.dealt(mentions="document_id", indicators="document_id")
    held = c["mentions"].join(c["indicators"], "document_id").select("entity_id", "document_id", "value", "risk").repartition(n, "entity_id")
    named = c["entities"].select("id", "name").repartition(n, "id").join(held, F.expr("id = entity_id")).groupBy("id", "name")
    found = named.agg(F.count_distinct("value").alias("n_values"), F.sum("risk").alias("risk"), F.count_distinct("document_id").alias("docs"))
    return found.orderBy(F.col("risk").desc(), "id").limit(50)


def _orphans(c: Corpus) -> DataFrame:
    """Events of documents that mention no entity."""
    return pairs.not_among(c["dated"].select("id", "document_id", "event_date"), "document_id", c["mentions"].select("document_id"))


def _unresolved(c: Corpus) -> DataFrame:
    """Entities of most documents of those that are on neither end of a resolution."""
    merged = c["resolutions"]
    e = pairs.not_among(c["entities"].select("id", "name"), "id", merged.select("source_entity_id"))
    e = pairs.not_among(e, "id", merged.select("canonical_entity_id"))
    docs = c["mentions"].select(F.col("entity_id").alias("id"), "document_id").join(e, "id")
    return docs.groupBy("id", "name").agg(F.count_distinct("document_id").alias("doc_count")).orderBy(F.col("doc_count").desc(), "id").limit(200)


def _disambiguation(c: Corpus) -> DataFrame:
    """Pairs of entities of one type of which one's name is part of the other's.

    A name looks for longer ones under the rarest of its trigrams, a name of one or two letters under itself.
    """
    e = c["entities"].select("id", "type", F.lower("name").alias("n"))
    names = e.filter("n <> ''").select("type", "n").distinct()
    grams = names.select("type", "n", F.explode(F.expr("array_distinct(transform(sequence(1, greatest(length(n) - 2, 1)), k -> substr(n, k, 3)))")).alias("key")).filter("length(key) = 3")
    rare = grams.join(grams.groupBy("type", "key").agg(F.count("*").alias("f")), ["type", "key"]).groupBy("type", "n").agg(F.min(F.struct("f", "key")).alias("m")).select("type", F.col("n").alias("short"), "m.key")
    tiny = names.filter("length(n) <= 2").select("type", F.col("n").alias("short"), F.col("n").alias("key"))
    bits = names.select("type", "n", F.explode(F.expr("array_distinct(flatten(transform(sequence(1, length(n)), k -> array(substr(n, k, 1), substr(n, k, 2)))))")).alias("key"))
    held = grams.unionAll(bits).distinct().withColumnRenamed("n", "long")
    met = rare.unionAll(tiny).join(held, ["type", "key"]).filter("length(short) < length(long) AND contains(long, short)").select("type", "long", "short")
    both = met.join(e.toDF("x", "type", "long"), ["type", "long"]).join(e.toDF("y", "type", "short"), ["type", "short"])
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def _most_aliased(c: Corpus) -> int:
    return c["aliases"].agg(F.max("entity_id")).first()[0]


#: Query -> (route with its arguments over a corpus, statement).
ROUTES: dict[str, tuple[Callable[[Corpus], DataFrame], str | None]] = {
    "list_documents": (
        lambda c: api.list_documents(c, "legal", True).select("id", "title", "category", "ingest_day"),
        "SELECT id, title, category, ingest_day FROM {docs} WHERE category = 'legal' AND flagged ORDER BY ingest_day DESC, id LIMIT 50",
    ),
    "list_documents_page": (lambda c: api.list_documents(c, limit=25, offset=75).select("id", "ingest_day"), "SELECT id, ingest_day FROM (SELECT id, ingest_day, row_number() OVER (ORDER BY ingest_day DESC, id) AS r FROM {docs}) WHERE r BETWEEN 76 AND 100"),
    "get_document": (lambda c: api.get_document(c, 7)["document"].select("id", "filename", "title", "category", "source", "date", "pages", "flagged"), f"SELECT {_DOC} FROM {{docs}} WHERE id = 7"),
    "get_document_entities": (lambda c: api.document_entities(c, 7), "SELECT id, name, type, count FROM {entities} JOIN {mentions} ON entity_id = id AND document_id = 7"),
    "get_document_keywords": (lambda c: api.document_keywords(c, 5), "SELECT word, count FROM (SELECT word, count, row_number() OVER (ORDER BY count DESC, word) AS r FROM {keywords} WHERE document_id = 5) WHERE r <= 30"),
    "get_document_text": (lambda c: api.document_text(c, 5), "SELECT doc_id AS id, text, length(text)::BIGINT AS n_chars FROM documents WHERE doc_id = 5 AND text IS NOT NULL"),
    "get_document_notes": (lambda c: api.document_notes(c, 7), "SELECT id, notes, flagged FROM {docs} WHERE id = 7"),
    "document_similar": (
        lambda c: api.document_similar(c, 7),
        "WITH s AS (SELECT document_id, list(DISTINCT entity_id) AS es FROM {mentions} GROUP BY document_id), own AS (SELECT es AS mine FROM s WHERE document_id = 7), j AS (SELECT document_id, len(list_intersect(es, mine)) AS shared, len(list_distinct(es || mine)) AS every FROM s, own WHERE document_id <> 7) SELECT document_id, shared, round(shared / every, 6) AS jaccard FROM j WHERE shared > 0 ORDER BY jaccard DESC, document_id LIMIT 10",
    ),
    "cross_references": (
        lambda c: api.cross_references(c, 32, "A red widget and a blue gear", limit=None).select("document_id", "hits"),
        "SELECT document_id, count(DISTINCT entity_id) AS hits FROM {mentions} WHERE document_id <> 32 AND entity_id IN (SELECT id FROM {entities} WHERE length(name) >= 3 AND position(lower(name) IN 'a red widget and a blue gear') > 0 ORDER BY length(name) DESC, id LIMIT 20) GROUP BY document_id",
    ),
    "cross_references_of_a_passage": (
        lambda c: api.cross_references(c, None, "of the", limit=None).select("document_id", "phrase"),
        "SELECT doc_id AS document_id, true AS phrase FROM documents WHERE position('of the' IN lower(text)) > 0",
    ),
    "compare_documents": (
        lambda c: api.compare_documents(c, 7, 32)["stats"],
        "WITH a AS (SELECT list(DISTINCT entity_id) AS x FROM {mentions} WHERE document_id = 7), b AS (SELECT list(DISTINCT entity_id) AS y FROM {mentions} WHERE document_id = 32) SELECT len(x) AS entities_a, len(y) AS entities_b, len(list_intersect(x, y)) AS shared, round(len(list_intersect(x, y)) / greatest(len(list_distinct(x || y)), 1), 3) AS jaccard FROM a, b",
    ),
    "compare_documents_only": (lambda c: api.compare_documents(c, 7, 32)["only_a"], "SELECT id, name, type, count FROM {entities} JOIN {mentions} ON entity_id = id AND document_id = 7 WHERE id NOT IN (SELECT entity_id FROM {mentions} WHERE document_id = 32) ORDER BY count DESC, id LIMIT 20"),
    "document_sidebyside_keywords": (lambda c: api.document_sidebyside(c, 1, 2), "SELECT word, CAST(sum(CASE WHEN document_id = 1 THEN count END) AS BIGINT) AS count_a, CAST(sum(CASE WHEN document_id = 2 THEN count END) AS BIGINT) AS count_b FROM {keywords} WHERE document_id IN (1, 2) GROUP BY word HAVING count(*) = 2"),
    "forensics_document": (lambda c: api.document_forensics(c, 143), "SELECT analysis_type, label, percent, severity FROM {facts} WHERE document_id = 143"),
    "get_redactions": (lambda c: api.document_redactions(c, 12), "SELECT reason, start_offset, end_offset FROM {redactions} WHERE document_id = 12"),
    "get_document_pdf_metadata": (lambda c: api.document_pdf_metadata(c, 4).select("document_id", "author", "producer", "creation_date"), "SELECT document_id, author, producer, creation_date FROM {pdf_metadata} WHERE document_id = 4"),
    "search_pdf_metadata": (lambda c: api.search_pdf_metadata(c, author="mach", encrypted=True), "SELECT document_id, author, creator, producer, creation_date, modification_date, encrypted FROM {pdf_metadata} WHERE author ILIKE '%MACH%' AND encrypted ORDER BY document_id LIMIT 50"),
    "advanced_search": (
        _advanced,
        "SELECT id, title, category, source, date FROM {docs} WHERE category = 'report' AND date >= '1996-01-01' AND date <= '1998-12-31' AND id IN (SELECT document_id FROM {mentions} JOIN {entities} e ON e.id = entity_id WHERE e.name ILIKE '%blue%') AND id IN (SELECT document_id FROM {facts} WHERE analysis_type = 'risk_score' AND percent >= 50)",
    ),
    "advanced_search_by_pages": (lambda c: api.advanced_search(c, source="NATION_6", flagged_only=True, sort_by="pages", limit=20, offset=5).select("id", "pages"), "SELECT id, pages FROM {docs} WHERE source = 'NATION_6' AND flagged ORDER BY pages DESC, id LIMIT 20 OFFSET 5"),
    "search_listing": (lambda c: api.search_documents(c, category="flight", limit=10).select("id", "title"), "SELECT id, title FROM {docs} WHERE category = 'flight' ORDER BY ingest_day DESC, id LIMIT 10"),
    "keyword_context": (lambda c: api.keyword_context(c, "Example"), "SELECT doc_id AS id, substr(text, greatest(position('example' IN lower(text)) - 100, 1), 207) AS snippet FROM documents WHERE position('example' IN lower(text)) > 0"),
    "list_keywords": (lambda c: api.list_keywords(c), "SELECT word, CAST(sum(count) AS BIGINT) AS total_count, count(DISTINCT document_id) AS doc_count FROM {keywords} GROUP BY word ORDER BY total_count DESC, word LIMIT 30"),
    "list_entities": (lambda c: api.list_entities(c), f"SELECT id, name, type, doc_count, mentions FROM {{entities}} JOIN ({_MENTIONED}) ON entity_id = id ORDER BY mentions DESC, id LIMIT 30"),
    "list_entities_person": (lambda c: api.list_entities(c, "person").drop("type"), f"SELECT id, name, doc_count, mentions FROM {{entities}} JOIN ({_MENTIONED}) ON entity_id = id WHERE type = 'person' ORDER BY mentions DESC, id LIMIT 30"),
    "search_entities": (lambda c: api.search_entities(c, "RED"), f"SELECT id, name, type, doc_count, mentions FROM {{entities}} JOIN ({_MENTIONED}) ON entity_id = id WHERE lower(name) LIKE '%red%' ORDER BY mentions DESC, id LIMIT 10"),
    "entity_documents": (lambda c: api.entity_documents(c, 7).drop("date"), "SELECT id, title, category, count FROM {docs} JOIN {mentions} ON document_id = id AND entity_id = 7 ORDER BY count DESC, id LIMIT 20"),
    "entity_profile_totals": (lambda c: api.entity_profile(c, 7)["totals"], "SELECT count(*) AS document_count, CAST(coalesce(sum(count), 0) AS BIGINT) AS total_mentions FROM {mentions} WHERE entity_id = 7 AND document_id IN (SELECT id FROM {docs})"),
    "entity_profile_timeline": (lambda c: api.entity_profile(c, 7)["timeline"].select("id", "event_date"), "SELECT id, event_date FROM {dated} WHERE event_date IS NOT NULL AND confidence >= 0.5 AND document_id IN (SELECT document_id FROM {mentions} WHERE entity_id = 7) ORDER BY event_date, id LIMIT 50"),
    "entity_connections": (lambda c: api.entity_connections(c, 7), "SELECT e.id, e.name, e.type, weight FROM {links} JOIN {entities} e ON e.id = CASE WHEN entity_a_id = 7 THEN entity_b_id ELSE entity_a_id END WHERE 7 IN (entity_a_id, entity_b_id) ORDER BY weight DESC, e.id LIMIT 30"),
    "entity_timeline_events": (lambda c: api.entity_timeline(c, 7)["events"].select("id", "event_date", "doc_title"), "SELECT v.id, v.event_date, d.title AS doc_title FROM {event_entities} x JOIN {dated} v ON v.id = x.event_id LEFT JOIN {docs} d ON d.id = v.document_id WHERE x.entity_id = 7"),
    "entity_timeline_coentities": (lambda c: api.entity_partners(c, 7), "SELECT id, name, type, shared FROM {entities} JOIN (SELECT entity_id, count(DISTINCT document_id) AS shared FROM {mentions} WHERE entity_id <> 7 AND document_id IN (SELECT document_id FROM {mentions} WHERE entity_id = 7) GROUP BY 1) ON entity_id = id ORDER BY shared DESC, id LIMIT 15"),
    "get_entity_tags": (lambda c: api.entity_tags(c, 30), "SELECT tag FROM {tags} WHERE entity_id = 30"),
    "entities_by_tag": (lambda c: api.entities_by_tag(c, "key"), f"SELECT id, name, type, coalesce(doc_count, 0) AS doc_count, coalesce(mentions, 0) AS mentions FROM {{entities}} LEFT JOIN ({_MENTIONED}) ON entity_id = id WHERE id IN (SELECT entity_id FROM {{tags}} WHERE tag = 'key')"),
    "get_aliases": (lambda c: api.entity_aliases(c, _most_aliased(c)), "SELECT alias_name FROM {aliases} WHERE entity_id = (SELECT max(entity_id) FROM {aliases})"),
    "resolve_alias": (
        lambda c: api.resolve_alias(c, c["aliases"].agg(F.upper(F.min("alias_name"))).first()[0]).select("id", "name", "via"),
        "SELECT e.id, e.name, 'alias' AS via FROM {aliases} a JOIN {entities} e ON e.id = a.entity_id WHERE a.alias_name = (SELECT min(alias_name) FROM {aliases}) ORDER BY e.id LIMIT 1",
    ),
    "resolve_alias_direct": (lambda c: api.resolve_alias(c, "Red Widget").select("id", "name", "type", "via"), "SELECT id, name, type, 'direct' AS via FROM {entities} WHERE lower(name) = 'red widget' ORDER BY id LIMIT 1"),
    "merge_preview": (
        lambda c: api.merge_preview(c, 5, 9),
        "WITH a AS (SELECT list(DISTINCT document_id) AS x, CAST(coalesce(sum(count), 0) AS BIGINT) AS m FROM {mentions} WHERE entity_id = 5), b AS (SELECT list(DISTINCT document_id) AS y, CAST(coalesce(sum(count), 0) AS BIGINT) AS n FROM {mentions} WHERE entity_id = 9) SELECT len(x) AS source_docs, len(y) AS target_docs, len(list_intersect(x, y)) AS shared, len(list_distinct(x || y)) AS merged_docs, m AS source_mentions, n AS target_mentions, (SELECT count(*) FROM {links} WHERE 5 IN (entity_a_id, entity_b_id)) AS source_connections, (SELECT count(*) FROM {links} WHERE 9 IN (entity_a_id, entity_b_id)) AS target_connections, coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM {tags} WHERE entity_id IN (5, 9)), '') AS merged_tags FROM a, b",
    ),
    "query_timeline": (
        lambda c: api.get_timeline(c, start="1996", end="1997-06", entity="Blue", min_confidence=0.5).select("id", "event_date", "doc_title"),
        "SELECT v.id, v.event_date, d.title AS doc_title FROM {dated} v JOIN {docs} d ON d.id = v.document_id WHERE v.is_resolved AND v.confidence >= 0.5 AND v.event_date >= '1996' AND v.event_date <= '1997-06' AND v.id IN (SELECT event_id FROM {event_entities} JOIN {entities} e ON e.id = entity_id WHERE e.canonical LIKE '%blue%') ORDER BY v.event_date, v.id LIMIT 200",
    ),
    "query_timeline_unresolved": (lambda c: api.get_timeline(c, document_id=2, include_unresolved=True).select("id", "event_date", "precision"), "SELECT id, event_date, precision FROM {dated} WHERE document_id = 2"),
    "timeline_overlay": (lambda c: api.timeline_overlay(c, [3, 7, 12]), "SELECT DISTINCT entity_id, id, event_date, precision FROM {event_entities} JOIN {dated} ON id = event_id WHERE entity_id IN (3, 7, 12)"),
    "visualization_entity_timeline": (lambda c: api.entity_event_dates(c, 7), "SELECT id, event_date FROM {dated} WHERE document_id IN (SELECT document_id FROM {mentions} WHERE entity_id = 7)"),
    "unresolved_dates": (lambda c: api.unresolved_dates(c), "SELECT id, document_id, context FROM {dated} WHERE event_date IS NULL ORDER BY id LIMIT 50"),
    "get_connections": (
        lambda c: api.get_connections(c, min_weight=2).select("entity_a_id", "name_a", "entity_b_id", "name_b", "weight"),
        "SELECT entity_a_id, a.name AS name_a, entity_b_id, b.name AS name_b, weight FROM {links}, {entities} a, {entities} b WHERE a.id = entity_a_id AND b.id = entity_b_id AND weight >= 2 ORDER BY weight DESC, entity_a_id, entity_b_id LIMIT 50",
    ),
    "get_connections_of_one": (
        lambda c: api.get_connections(c, entity_id=7, limit=20).select("entity_a_id", "entity_b_id", "type_a", "type_b", "weight"),
        "SELECT entity_a_id, entity_b_id, a.type AS type_a, b.type AS type_b, weight FROM {links}, {entities} a, {entities} b WHERE a.id = entity_a_id AND b.id = entity_b_id AND 7 IN (entity_a_id, entity_b_id) ORDER BY weight DESC, entity_a_id, entity_b_id LIMIT 20",
    ),
    "narrative_people_by_documents": (lambda c: api.narrative(c)["key_people"], f"SELECT id, name, type, doc_count, mentions FROM {{entities}} JOIN ({_MENTIONED}) ON entity_id = id WHERE type = 'person' ORDER BY doc_count DESC, id LIMIT 20"),
    "narrative_events": (lambda c: api.narrative(c, 7)["timeline_events"].select("id", "event_date", "doc_title"), "SELECT v.id, v.event_date, d.title AS doc_title FROM {dated} v JOIN {event_entities} x ON x.event_id = v.id AND x.entity_id = 7 LEFT JOIN {docs} d ON d.id = v.document_id WHERE v.event_date <> '' AND v.confidence >= 0.5 ORDER BY v.event_date, v.id LIMIT 50"),
    "narrative_money": (lambda c: api.narrative(c)["financial_summary"], "SELECT indicator_type, count(*) AS n, round(avg(risk), 6) AS avg_risk FROM {indicators} GROUP BY indicator_type"),
    "provenance_summary": (lambda c: api.provenance_summary(c)["summary"], "SELECT count(*) AS total_documents, count(p.document_id) AS tracked_documents, count(*) - count(p.document_id) AS untracked FROM {docs} LEFT JOIN (SELECT DISTINCT document_id FROM {provenance}) p ON p.document_id = id"),
    "provenance_event_types": (lambda c: api.provenance_summary(c)["event_types"], "SELECT event_type, count(*) AS n FROM {provenance} GROUP BY event_type"),
    "provenance_recent": (lambda c: api.provenance_summary(c)["recent"], "SELECT event_type, event_date, description, actor, title, document_id, created_at FROM {provenance} JOIN {docs} d ON d.id = document_id ORDER BY created_at DESC, document_id LIMIT 20"),
    "document_clusters": (
        lambda c: api.document_clusters(c)["clusters"],
        "SELECT keyword, count(*) AS size FROM (SELECT document_id, arg_min(word, (-count, word)) AS keyword FROM {keywords} GROUP BY document_id) GROUP BY keyword HAVING count(*) >= 3 ORDER BY size DESC, keyword LIMIT 20",
    ),
    "document_clusters_members": (
        lambda c: api.document_clusters(c)["documents"],
        "WITH k AS (SELECT document_id, arg_min(word, (-count, word)) AS keyword FROM {keywords} GROUP BY document_id), big AS (SELECT keyword FROM k GROUP BY keyword HAVING count(*) >= 3 ORDER BY count(*) DESC, keyword LIMIT 20) SELECT keyword, document_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY document_id) AS r FROM k WHERE keyword IN (SELECT keyword FROM big)) WHERE r <= 10",
    ),
    "cluster_map": (lambda c: api.cluster_map(c)["clusters"], "SELECT category, count(*) AS doc_count FROM {docs} GROUP BY category HAVING count(*) >= 3"),
    "cluster_map_entities": (
        lambda c: api.cluster_map(c)["top_entities"].select("category", "id", "count", "rank"),
        "WITH f AS (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id) AS r FROM {docs}), n AS (SELECT category, entity_id, count(*) AS count FROM f JOIN {mentions} ON document_id = id WHERE r <= 50 GROUP BY 1, 2) SELECT category, entity_id AS id, count, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY count DESC, entity_id) AS rank FROM n) WHERE rank <= 10",
    ),
    "graph_centrality_top": (
        lambda c: api.graph_centrality(c, "degree", "person", 20).select("node", "name", "type"),
        "WITH p AS (SELECT id FROM {entities} WHERE type = 'person'), r AS (SELECT coalesce(x.canonical_entity_id, entity_a_id) AS a, coalesce(y.canonical_entity_id, entity_b_id) AS b FROM {links} LEFT JOIN {resolutions} x ON x.source_entity_id = entity_a_id LEFT JOIN {resolutions} y ON y.source_entity_id = entity_b_id), g AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM r WHERE a <> b AND a IN (SELECT id FROM p) AND b IN (SELECT id FROM p)), d AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM g UNION ALL SELECT b FROM g) GROUP BY node) SELECT node, name, type FROM d JOIN {entities} e ON e.id = node ORDER BY n DESC, node LIMIT 20",
    ),
    "generate_title": (
        lambda c: _texts(c).select("id", phrases.title(F.col("text"), F.col("filename")).alias("title")),
        f"""WITH t AS ({_TEXTS}), l AS (SELECT id, filename, list_filter(list_transform(string_split(trim(text, ' \t\n\r\f'), chr(10))[1:10], lambda x: trim(x, ' \t\n\r\f')), lambda x: length(x) BETWEEN 11 AND 79 AND NOT (starts_with(x, 'page') OR starts_with(x, 'Page') OR starts_with(x, '#'))) AS lines FROM t)
        SELECT id, CASE WHEN len(lines) > 0 THEN lines[1] ELSE array_to_string(list_transform(string_split(replace(replace(regexp_replace(filename, '(.)\\.[^.]*$', '\\1'), '_', ' '), '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS title FROM l""".replace("\\t\\n\\r\\f", "\t\n\r\f"),
    ),
    "extract_keywords": (
        lambda c: phrases.keywords(c["texts"]),
        f"""WITH w AS (SELECT id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains({_STOPS}, w)) AS ws FROM {{texts}}),
        x AS (SELECT id, 0 AS pair, p AS place, ws[p] AS word FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) UNION ALL SELECT id, 1, p, ws[p] || ' ' || ws[p + 1] FROM (SELECT id, ws, unnest(range(1, len(ws))) AS p FROM w)),
        n AS (SELECT id, pair, word, count(*) AS count, min(place) AS place FROM x GROUP BY ALL)
        SELECT id, word, count, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, pair, place) AS rank FROM n) WHERE rank <= 50""",
    ),
    "forensics_phrases": (lambda c: phrases.phrase_totals(phrases.repeated_phrases(c["texts"])), f"WITH {_PHRASES} SELECT phrase, count(*) AS doc_count, CAST(sum(count) AS BIGINT) AS total_count FROM ranked WHERE rank <= 50 GROUP BY phrase"),
    "repeated_phrases": (lambda c: phrases.repeated_phrases(c["texts"]), f"WITH {_PHRASES} SELECT id, phrase, count, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 50"),
    "phrase_trends": (
        lambda c: api.phrase_trends(c),
        f"WITH {_PHRASES}, kept AS (SELECT * FROM ranked WHERE rank <= 50), top AS (SELECT phrase, count(*) AS doc_count, CAST(sum(count) AS BIGINT) AS total_count FROM kept GROUP BY phrase ORDER BY doc_count DESC, phrase LIMIT 20) SELECT phrase, doc_count, total_count, substr(d.date, 1, 4) AS year, count(*) AS n FROM kept JOIN top USING (phrase) JOIN {{docs}} d ON d.id = kept.id GROUP BY ALL",
    ),
    "keyword_cooccurrence": (_keyword_pairs, documents.PLANS["keyword_cooccurrence"]),
    "entity_pair_codocs": (lambda c: pairs.best_shared(c["mentions"], "document_id", "entity_id", 100).toDF("id_a", "id_b", "shared"), more.PLANS["entity_pair_codocs"]),
    "document_shared_entities": (lambda c: pairs.best_shared(c["mentions"], "entity_id", "document_id", 100).toDF("doc_a", "doc_b", "shared"), documents.PLANS["document_shared_entities"]),
    "export_documents": (lambda c: c.dealt(docs="id", mentions="document_id").sql(documents.PLANS["export_documents"]), documents.PLANS["export_documents"]),
    "entity_path_suggestions": (lambda c: c.dealt(entities="id", mentions="entity_id").sql(entities.PLANS["entity_path_suggestions"]), entities.PLANS["entity_path_suggestions"]),
    "financial_entity_links": (_financial, events.PLANS["financial_entity_links"]),
    "orphan_events": (_orphans, events.PLANS["orphan_events"]),
    "unresolved_entities_summary": (_unresolved, entities.PLANS["unresolved_entities_summary"]),
    "entity_clusters": (
        lambda c: pairs.sharing(c["mentions"], "document_id", "entity_id", 2).toDF("doc_a", "doc_b", "shared"),
        "SELECT a.document_id AS doc_a, b.document_id AS doc_b, count(*) AS shared FROM {mentions} a JOIN {mentions} b ON a.entity_id = b.entity_id AND a.document_id < b.document_id GROUP BY 1, 2 HAVING count(*) >= 2",
    ),
    "detect_duplicates": (
        lambda c: pairs.overlapping(c["mentions"], "document_id", "entity_id", 0.6).toDF("doc_a", "doc_b", "shared"),
        "WITH n AS (SELECT document_id, count(*) AS n FROM {mentions} GROUP BY document_id), s AS (SELECT a.document_id AS doc_a, b.document_id AS doc_b, count(*) AS shared FROM {mentions} a JOIN {mentions} b ON a.entity_id = b.entity_id AND a.document_id < b.document_id GROUP BY 1, 2) SELECT doc_a, doc_b, shared FROM s JOIN n x ON x.document_id = doc_a JOIN n y ON y.document_id = doc_b WHERE shared >= 0.6 * least(x.n, y.n)",
    ),
    "patterns_same_day": (
        _same_day,
        "WITH ed AS (SELECT DISTINCT e.id, e.type, d.date FROM {entities} e JOIN {mentions} m ON e.id = m.entity_id JOIN {docs} d ON d.id = m.document_id) SELECT a.id AS id_a, b.id AS id_b, count(*) AS days FROM ed a JOIN ed b ON a.date = b.date AND a.id < b.id WHERE a.type = 'person' GROUP BY a.id, b.id HAVING count(*) >= 3",
    ),
    "source_overlap": (
        lambda c: pairs.co_occurrence(c["mentions"].join(c["docs"], F.col("id") == F.col("document_id")), "entity_id", "source").toDF("source_a", "source_b", "shared"),
        "SELECT a.source AS source_a, b.source AS source_b, count(DISTINCT x.entity_id) AS shared FROM {mentions} x JOIN {mentions} y ON x.entity_id = y.entity_id AND x.document_id <> y.document_id JOIN {docs} a ON a.id = x.document_id JOIN {docs} b ON b.id = y.document_id WHERE a.source < b.source GROUP BY a.source, b.source",
    ),
    "entity_disambiguation": (
        _disambiguation,
        "WITH n AS (SELECT DISTINCT type, lower(name) AS n FROM {entities}), p AS (SELECT a.type, a.n AS long_name, b.n AS short_name FROM n a JOIN n b ON a.type = b.type AND length(a.n) > length(b.n) AND contains(a.n, b.n)), q AS (SELECT p.type, x.id AS x, y.id AS y FROM p JOIN {entities} x ON x.type = p.type AND lower(x.name) = p.long_name JOIN {entities} y ON y.type = p.type AND lower(y.name) = p.short_name) SELECT least(x, y) AS id_a, greatest(x, y) AS id_b FROM q",
    ),
    "redacted_text": (
        lambda c: phrases.redacted(c["texts"], c["redactions"]),
        """WITH c AS (SELECT t.id, text, least(start_offset, length(text)) AS s, least(end_offset, length(text)) AS e FROM {redactions} JOIN {texts} t ON t.id = document_id),
        g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, e) AS o, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM c),
        h AS (SELECT *, sum(CASE WHEN s < reached THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g),
        m AS (SELECT id, any_value(text) AS text, k, min(s) AS s, max(e) AS e, count(*) AS n FROM h GROUP BY id, k), p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY id ORDER BY k), 0) AS after FROM m)
        SELECT id, string_agg(substr(text, after + 1, s - after) || '[REDACTED]', '' ORDER BY k) || substr(any_value(text), max(e) + 1) AS text, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY id""",
    ),
    "detect_codewords": (
        lambda c: phrases.codewords(_texts(c)).select("id", "word", "count", "note", "rank"),
        f"""WITH t AS (SELECT id, text, lower(text) AS low FROM ({_TEXTS})), k AS (SELECT unnest({_list(phrases.L.CODEWORDS)}) AS word, unnest(range({len(phrases.L.CODEWORDS)})) AS place),
        plain AS (SELECT id, 0 AS kind, place, word, CAST(floor((length(low) - length(replace(low, word, ''))) / length(word)) AS BIGINT) AS count, 'potential codeword' AS note FROM t JOIN k ON contains(low, word)),
        raw AS (SELECT id, unnest(found) AS w, unnest(range(len(found))) AS place FROM (SELECT id, list_transform(regexp_extract_all(text, '["“”]([\\pL\\pN_]+(?:\\s+[\\pL\\pN_]+)?)["“”]', 1), lambda x: lower(x)) AS found FROM t)),
        quoted AS (SELECT id, 1 AS kind, min(place) AS place, '"' || w || '"' AS word, CAST(1 AS BIGINT) AS count, 'quoted ordinary word' AS note FROM raw WHERE length(w) >= 3 AND w NOT IN ('said', 'told', 'asked', 'the', 'and', 'but') AND list_contains({_list([*phrases.L.CODEWORDS, *phrases.COMMON_WORDS])}, w) GROUP BY id, w)
        SELECT id, word, count, note, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, kind, place) AS rank FROM (SELECT * FROM plain UNION ALL SELECT * FROM quoted)) WHERE rank <= 30""",
    ),
}


_FREQUENT = "SELECT entity_id, CAST(sum(count) AS BIGINT) AS total, count(DISTINCT document_id) AS doc_count FROM {mentions} GROUP BY entity_id"
ROUTES |= {
    "detect_anomalies_spikes": (
        lambda c: api.detect_anomalies(c, spike=1.8)["temporal_spikes"],
        """WITH d AS (SELECT event_date AS date, count(*) AS count FROM {dated} WHERE length(event_date) >= 10 AND confidence >= 0.5 GROUP BY 1), m AS (SELECT avg(count) AS mean FROM d)
        SELECT date, count, round(mean, 1) AS avg, round(count / mean, 1) AS ratio FROM d, m WHERE count >= 5 AND count >= 1.8 * mean ORDER BY count DESC, date LIMIT 20""",
    ),
    "detect_anomalies_pairs": (
        lambda c: api.detect_anomalies(c, least_weight=2)["entity_anomalies"].select("entity_a_id", "entity_b_id", "type_b", "co_occurrences", "ratio"),
        f"""WITH n AS ({_FREQUENT}) SELECT entity_a_id, entity_b_id, b.type AS type_b, weight AS co_occurrences, round(100.0 * weight / (coalesce(x.total, 1) + coalesce(y.total, 1)), 1) AS ratio FROM {{links}}
        JOIN {{entities}} a ON a.id = entity_a_id AND a.type = 'person' JOIN {{entities}} b ON b.id = entity_b_id AND b.type IN ('person', 'org', 'place') LEFT JOIN n x ON x.entity_id = entity_a_id LEFT JOIN n y ON y.entity_id = entity_b_id
        WHERE weight >= 2 ORDER BY CAST(weight AS DOUBLE) / (coalesce(x.total, 1) + coalesce(y.total, 1)) DESC, entity_a_id, entity_b_id LIMIT 20""",
    ),
    "detect_anomalies_money": (
        lambda c: api.detect_anomalies(c, least_indicators=3, limit=15)["financial_clusters"].select("id", "category", "indicator_count", "avg_risk", "types"),
        "SELECT id, any_value(category) AS category, count(*) AS indicator_count, round(avg(risk), 3) AS avg_risk, string_agg(DISTINCT indicator_type, ',' ORDER BY indicator_type) AS types FROM {indicators} JOIN {docs} ON id = document_id GROUP BY id HAVING count(*) >= 3 ORDER BY indicator_count DESC, id LIMIT 15",
    ),
    "detect_anomalies_isolated": (
        lambda c: api.detect_anomalies(c)["isolated_entities"],
        f"SELECT id, name, type, total AS total_mentions, doc_count FROM {{entities}} JOIN ({_FREQUENT}) n ON entity_id = id WHERE type IN ('person', 'org') AND total >= 10 AND doc_count <= 2 ORDER BY total DESC, id LIMIT 20",
    ),
    "fts_statistics": (
        lambda c: api.fts_stats(c)["totals"],
        "SELECT count(*) AS indexed_docs, count(*) AS total_docs, count(t.id) AS with_text, CAST(100 AS DOUBLE) AS coverage_pct FROM {docs} d LEFT JOIN (SELECT id FROM {texts} WHERE text <> '') t ON t.id = d.id",
    ),
    "fts_statistics_by_category": (
        lambda c: api.fts_stats(c)["by_category"],
        "SELECT category, count(*) AS n FROM {docs} d JOIN {texts} t ON t.id = d.id AND t.text <> '' GROUP BY category",
    ),
    "ocr_quality_pages": (
        lambda c: api.ocr_quality(c),
        r"""WITH p AS (SELECT id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS page_number FROM (SELECT id, list_transform(range(0, (length(text) + 2999) // 3000), lambda k: substr(text, k * 3000 + 1, 3000)) AS ps FROM {texts} WHERE text NOT LIKE '%' || chr(12) || '%')),
        q AS (SELECT id, page_number, length(p) AS n, length(regexp_replace(p, '[^\pL]', '', 'g')) / length(p) AS alpha, (length(p) - length(replace(p, ' ', ''))) / length(p) AS space, length(regexp_replace(p, '[\x00-\x7F\pL]', '', 'g')) / length(p) AS odd,
            len(regexp_extract_all(p, '[^ \t\n\x0B\f\r]+')) AS words, length(regexp_replace(p, '[ \t\n\x0B\f\r]', '', 'g')) / greatest(len(regexp_extract_all(p, '[^ \t\n\x0B\f\r]+')), 1) AS size FROM p)
        SELECT id, CAST(page_number AS INTEGER) AS page_number, n AS char_count, words AS word_count,
            round(CASE WHEN n < 50 THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN alpha < 0.4 THEN 0.5 ELSE 1 END * CASE WHEN odd > 0.05 THEN 0.4 ELSE 1 END * CASE WHEN space < 0.05 OR space > 0.5 THEN 0.6 ELSE 1 END * CASE WHEN size > 15 OR size < 2 THEN 0.5 ELSE 1 END, 3) AS quality_score,
            round(alpha, 3) AS alpha_ratio, concat_ws(',', CASE WHEN n < 50 THEN 'short_text' END, CASE WHEN alpha < 0.4 THEN 'low_alpha' END, CASE WHEN odd > 0.05 THEN 'garbage_chars' END,
            CASE WHEN space < 0.05 OR space > 0.5 THEN 'spacing_abnormal' END, CASE WHEN size > 15 OR size < 2 THEN 'word_length_abnormal' END) AS issues FROM q""",
    ),
    "resolution_classes": (
        lambda c: api.resolution_classes(c, limit=25),
        "SELECT min(id) AS class_id, type, lower(name) AS n, count(*) AS size, max(id) AS last FROM {entities} GROUP BY type, lower(name) HAVING count(*) >= 2 ORDER BY size DESC, class_id LIMIT 25",
    ),
}


def _query(route: Callable[[Corpus], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: route(Corpus(spark, sf_dir))


QUERIES = {name: _query(route) for name, (route, _) in ROUTES.items()}
ORACLE = {name: sql for name, (_, sql) in ROUTES.items() if sql}
