"""The engine's reads, with their arguments: one function per route, each a DataFrame plan over a ``Corpus``.

Every function takes the corpus first, then its arguments by name, and returns a DataFrame, or a
dictionary of DataFrames where an answer has several parts.  Filters that are None do not apply.
Rows come in the order given, ties by id; ``limit`` and ``offset`` cut pages of that order, and
``limit=None`` gives all rows.  Text filters match substrings without regard to case.
An id that does not exist gives an empty answer.
"""

from __future__ import annotations

import datetime
import functools
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.bindings import Corpus
from quaestor.functions import fulltext, phrases
from quaestor.functions import search as fts
from quaestor.functions.fulltext import Fulltext
from quaestor.operators import anomaly, graph, pairs, resolve

_DOC = ["id", "filename", "title", "category", "source", "date", "pages", "flagged"]


def _page(df: DataFrame, order: Sequence[Column | str], limit: int | None, offset: int = 0) -> DataFrame:
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def _holds(column: str, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def _where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def _equal(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def _latest(c: Corpus) -> list[Column]:
    return [F.col("ingest_day").desc_nulls_last(), F.col("id")]


# documents


def list_documents(c: Corpus, category: str | None = None, flagged: bool | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Documents, last ingested first."""
    return _page(_where(c["docs"], _equal("category", category), _equal("flagged", flagged)).select(*_DOC, "ingest_day"), _latest(c), limit, offset)


def get_document(c: Corpus, doc_id: int, keywords: int = 30) -> dict[str, DataFrame]:
    """A document's row, entities and top keywords."""
    return {
        "document": c["docs"].filter(F.col("id") == doc_id),
        "entities": document_entities(c, doc_id),
        "keywords": document_keywords(c, doc_id, keywords),
    }


def document_entities(c: Corpus, doc_id: int) -> DataFrame:
    """Entities of a document, most mentioned first."""
    found = c["mentions"].filter(F.col("document_id") == doc_id).join(c["entities"], F.col("id") == F.col("entity_id"))
    return found.select("id", "name", "type", "count").orderBy(F.col("count").desc(), "id")


def document_keywords(c: Corpus, doc_id: int, limit: int | None = 30) -> DataFrame:
    return _page(c["keywords"].filter(F.col("document_id") == doc_id).select("word", "count"), [F.col("count").desc(), "word"], limit)


def document_text(c: Corpus, doc_id: int) -> DataFrame:
    return c["texts"].filter(F.col("id") == doc_id).select("id", "text", "n_chars")


def document_notes(c: Corpus, doc_id: int) -> DataFrame:
    return c["docs"].filter(F.col("id") == doc_id).select("id", "notes", "flagged")


def document_similar(c: Corpus, doc_id: int, limit: int | None = 10) -> DataFrame:
    """(document_id, shared, jaccard): documents that share entities with this one, by Jaccard similarity."""
    m = c["mentions"].select("document_id", "entity_id").distinct()
    own = m.filter(F.col("document_id") == doc_id).select("entity_id")
    size = own.agg(F.count("*").alias("own"))
    near = m.filter(F.col("document_id") != doc_id).join(F.broadcast(own), "entity_id").groupBy("document_id").agg(F.count("*").alias("shared"))  # one document's entities
    totals = m.join(near.select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("total"))
    found = near.join(totals, "document_id").crossJoin(size)  # one row
    found = found.select("document_id", "shared", F.round(F.col("shared") / (F.col("own") + F.col("total") - F.col("shared")), 6).alias("jaccard"))
    return _page(found, [F.col("jaccard").desc(), "document_id"], limit)


def cross_references(c: Corpus, doc_id: int | None, text: str, limit: int | None = 10, names: int = 20) -> DataFrame:
    """(document_id, hits, matched, phrase): other documents with entities that a passage names, then those with the passage itself."""
    known = _page(c["entities"].filter((F.length("name") >= 3) & F.contains(F.lit(text.lower()), F.lower("name"))), [F.length("name").desc(), "id"], names)
    others = c["mentions"] if doc_id is None else c["mentions"].filter(F.col("document_id") != doc_id)
    named = others.join(F.broadcast(known), F.col("id") == F.col("entity_id")).groupBy("document_id").agg(F.countDistinct("entity_id").alias("hits"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("matched"))  # ``names`` entities
    found = named.withColumn("phrase", F.lit(False))
    phrase = " ".join(text[:100].split())
    if len(phrase) >= 5:
        whole = c["texts"].filter(_holds("text", phrase)).select(F.col("id").alias("document_id"))
        whole = whole if doc_id is None else whole.filter(F.col("document_id") != doc_id)
        found = found.unionByName(whole.join(named, "document_id", "left_anti").select("document_id", F.lit(0).cast("long").alias("hits"), F.lit("").alias("matched"), F.lit(True).alias("phrase")))
    return _page(found, [F.col("hits").desc(), "document_id"], limit)


def compare_documents(c: Corpus, doc_a: int, doc_b: int, shown: int = 30, only: int = 20, preview: int = 2000) -> dict[str, DataFrame]:
    """Entities shared by two documents and those of either alone, their counts with Jaccard similarity, and previews of the texts."""
    a, b = (c["mentions"].filter(F.col("document_id") == d).groupBy("entity_id").agg(F.sum("count").alias("count")) for d in (doc_a, doc_b))
    named = lambda df: _page(df.join(c["entities"], F.col("id") == F.col("entity_id")).select("id", "name", "type", "count"), [F.col("count").desc(), "id"], None)
    both = a.select("entity_id", F.lit(1).alias("a")).join(b.select("entity_id", F.lit(1).alias("b")), "entity_id", "full")
    n = both.agg(F.count("a").alias("entities_a"), F.count("b").alias("entities_b"), F.count(F.expr("a + b")).alias("shared"), F.count("*").alias("every"))
    stats = n.select("entities_a", "entities_b", "shared", F.round(F.col("shared") / F.greatest("every", F.lit(1)), 3).alias("jaccard"))
    docs = c["docs"].filter(F.col("id").isin(doc_a, doc_b)).select("id", "title", "category", "source", "pages")
    texts = c["texts"].filter(F.col("id").isin(doc_a, doc_b)).select("id", F.substring("text", 1, preview).alias("text_preview"))
    return {
        "documents": docs.join(texts, "id", "left"), "shared": named(a.join(b, "entity_id", "left_semi")).limit(shown),
        "only_a": named(a.join(b, "entity_id", "left_anti")).limit(only), "only_b": named(b.join(a, "entity_id", "left_anti")).limit(only), "stats": stats,
    }


def document_sidebyside(c: Corpus, doc_a: int, doc_b: int) -> DataFrame:
    """(word, count_a, count_b) of the keywords that two documents share."""
    a, b = (c["keywords"].filter(F.col("document_id") == d).select("word", F.col("count").alias(f"count_{s}")) for d, s in ((doc_a, "a"), (doc_b, "b")))
    return a.join(b, "word")


def document_forensics(c: Corpus, doc_id: int) -> DataFrame:
    return c["facts"].filter(F.col("document_id") == doc_id).select("analysis_type", "label", "percent", "severity")


def document_redactions(c: Corpus, doc_id: int) -> DataFrame:
    return c["redactions"].filter(F.col("document_id") == doc_id).select("reason", "start_offset", "end_offset")


def document_pdf_metadata(c: Corpus, doc_id: int) -> DataFrame:
    return c["pdf_metadata"].filter(F.col("document_id") == doc_id)


def search_pdf_metadata(c: Corpus, author: str | None = None, creator: str | None = None, producer: str | None = None, encrypted: bool | None = None, limit: int | None = 50) -> DataFrame:
    found = _where(c["pdf_metadata"], *(None if v is None else _holds(k, v) for k, v in (("author", author), ("creator", creator), ("producer", producer))), _equal("encrypted", encrypted))
    return _page(found, ["document_id"], limit)


# search


def _match(c: Corpus, q: str, index: fts.Index | Fulltext | None, weights: dict[str, float] | None = None) -> DataFrame:
    index = index or c.index
    if isinstance(index, Fulltext):
        found = fulltext.search(index, q, k=None, weights=weights)
    else:
        found = fts.search_texts(c["texts"], q, k=None) if index is None else fts.search(index, q, k=None)
    return found.select(F.col("doc_id").alias("hit"), "score")


def search_documents(
    c: Corpus, q: str = "", category: str | None = None, limit: int | None = 50, offset: int = 0, index: fts.Index | Fulltext | None = None, around: int = 40, weights: dict[str, float] | None = None,
) -> DataFrame:
    """Documents with the phrase ``q``, best first, with an excerpt; without ``q`` the last ingested.

    An ingested corpus keeps an index over title, text, category and source (``functions.fulltext``), whose ``weights`` by field may
    be given, and excerpts show the ``around`` words with the phrase marked.  Another ``index`` may be one of texts alone
    (``functions.search.Index.write``); without any the texts are scanned, and ``around`` counts characters.
    """
    docs = _where(c["docs"], _equal("category", category))
    texts = c["texts"].select(F.col("id").alias("hit"), "text")
    if not q.strip():
        rows = docs.join(texts, F.col("id") == F.col("hit"), "left").select(*_DOC, "ingest_day", F.substring("text", 1, 300).alias("excerpt"))
        return _page(rows, _latest(c), limit, offset).drop("ingest_day")
    found = _page(_match(c, q, index, weights).join(docs, F.col("hit") == F.col("id")), [F.col("score").desc(), "id"], limit, offset)
    kept = isinstance(index or c.index, Fulltext)
    excerpt = fulltext.excerpts(F.coalesce("text", F.lit("")), q, size=around) if kept else fts.snippet(F.col("text"), q, around)
    return found.join(texts, "hit", "left" if kept else "inner").select(*_DOC, excerpt.alias("excerpt"), "score").orderBy(F.col("score").desc(), "id")


def advanced_search(
    c: Corpus, q: str = "", category: str | None = None, source: str | None = None, date_from: str | None = None, date_to: str | None = None, entity_name: str | None = None,
    flagged_only: bool = False, min_risk: int | None = None, sort_by: str = "relevance", limit: int | None = 50, offset: int = 0, index: fts.Index | Fulltext | None = None,
) -> DataFrame:
    """Documents under any combination of filters; ``sort_by`` is relevance (with ``q``), date, pages or else the day of ingestion."""
    docs = _where(
        c["docs"], _equal("category", category), _equal("source", source), None if date_from is None else F.col("date") >= date_from,
        None if date_to is None else F.col("date") <= date_to, F.col("flagged") if flagged_only else None,
    )
    if entity_name:
        holders = c["mentions"].join(c["entities"].filter(_holds("name", entity_name)), F.col("id") == F.col("entity_id")).select("document_id")
        docs = docs.join(holders, F.col("id") == F.col("document_id"), "left_semi")
    if min_risk is not None:
        risky = c["facts"].filter((F.col("analysis_type") == "risk_score") & (F.col("percent") >= min_risk)).select("document_id")
        docs = docs.join(risky, F.col("id") == F.col("document_id"), "left_semi")
    if q.strip():
        docs = docs.join(_match(c, q, index), F.col("id") == F.col("hit")).drop("hit")
    order = {"date": [F.col("date").desc_nulls_last(), F.col("id")], "pages": [F.col("pages").desc(), F.col("id")]}.get(sort_by)
    order = order or ([F.col("score").desc(), F.col("id")] if sort_by == "relevance" and q.strip() else _latest(c))
    return _page(docs.select(*_DOC, "ingest_day", *(["score"] if q.strip() else [])), order, limit, offset)


def keyword_context(c: Corpus, keyword: str, around: int = 100, limit: int | None = None) -> DataFrame:
    """(id, snippet): the first place of a keyword in each text that holds it, with its surroundings."""
    word = keyword.lower()
    at = F.instr(F.lower("text"), word)
    start = F.greatest(at - around, F.lit(1))
    found = c["texts"].filter(_holds("text", word)).select("id", F.substring("text", start, F.lit(len(word) + 2 * around)).alias("snippet"))
    return _page(found, ["id"], limit)


def list_keywords(c: Corpus, limit: int | None = 30) -> DataFrame:
    totals = c["keywords"].groupBy("word").agg(F.sum("count").alias("total_count"), F.count("*").alias("doc_count"))
    return _page(totals, [F.col("total_count").desc(), "word"], limit)


def document_clusters(c: Corpus, min_cluster_size: int = 3, limit: int | None = 20, sample: int = 10, entities: int = 10) -> dict[str, DataFrame]:
    """Documents grouped by their most frequent keyword: clusters by size, the first members of each, and entities that a third of a cluster shares."""
    best = c["keywords"].groupBy("document_id").agg(F.min(F.struct((-F.col("count")).alias("count"), "word")).alias("m")).select("document_id", F.col("m.word").alias("keyword"))
    clusters = _page(best.groupBy("keyword").agg(F.count("*").alias("size")).filter(F.col("size") >= min_cluster_size), [F.col("size").desc(), "keyword"], limit)
    members = best.join(clusters, "keyword")
    first = pairs.top_per_group(members, ["keyword"], [F.col("document_id")], sample).select("keyword", "document_id", "rank")
    held = c["mentions"].join(members, "document_id").groupBy("keyword", "size", "entity_id").agg(F.countDistinct("document_id").alias("doc_count"))
    common = held.filter(F.col("doc_count") >= F.greatest(F.lit(2), F.floor(F.col("size") / 3)))
    top = pairs.top_per_group(common, ["keyword"], [F.col("doc_count").desc(), F.col("entity_id")], entities)
    return {"clusters": clusters, "documents": first, "shared_entities": top.join(c["entities"], F.col("id") == F.col("entity_id")).select("keyword", "id", "name", "type", "doc_count", "rank")}


def cluster_map(c: Corpus, min_cluster_size: int = 3, looked_at: int = 50, entities: int = 10) -> dict[str, DataFrame]:
    """Categories by number of documents, the entities that most of the first ``looked_at`` documents of each name, and the names that two categories share."""
    clusters = c["docs"].groupBy("category").agg(F.count("*").alias("doc_count")).filter(F.col("doc_count") >= min_cluster_size)
    first = pairs.top_per_group(c["docs"].select("category", F.col("id").alias("document_id")).join(clusters.select("category"), "category"), ["category"], [F.col("document_id")], looked_at).drop("rank")
    counted = c["mentions"].join(first, "document_id").groupBy("category", "entity_id").agg(F.count("*").alias("count"))
    top = pairs.top_per_group(counted, ["category"], [F.col("count").desc(), F.col("entity_id")], entities)
    top = top.join(c["entities"], F.col("id") == F.col("entity_id")).select("category", "id", "name", "type", "count", "rank")
    names = top.select("category", "name").distinct()
    both = names.toDF("cluster_a", "name").join(names.toDF("cluster_b", "name"), "name").filter("cluster_a < cluster_b")
    return {"clusters": clusters, "top_entities": top, "overlaps": both.groupBy("cluster_a", "cluster_b").agg(F.count("*").alias("overlap_count"))}


def phrase_trends(c: Corpus, top_n: int = 20) -> DataFrame:
    """Phrases that most texts repeat, by the year of their documents."""
    return phrases.phrase_trends(phrases.repeated_phrases(c["texts"]), c["docs"], top_n)


def narrative(c: Corpus, entity_id: int | None = None, limit: int = 50, chains: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a story is told from: persons of most documents, sure events (of one entity), financial indicators by kind, largest sources; ``chains`` of evidence are passed on."""
    people = _page(_totals(c, c["entities"].filter("type = 'person'")), [F.col("doc_count").desc(), "id"], 20)
    events = c["dated"].filter("event_date <> '' AND confidence >= 0.5")
    if entity_id is not None:
        events = events.join(c["event_entities"].filter(F.col("entity_id") == entity_id).select("event_id"), F.col("id") == F.col("event_id"), "left_semi")
    events = events.join(c["docs"].select(F.col("id").alias("document_id"), F.col("title").alias("doc_title")), "document_id", "left")
    money = c["indicators"].groupBy("indicator_type").agg(F.count("*").alias("n"), F.round(F.avg("risk"), 6).alias("avg_risk"))
    sources = c["docs"].filter("source <> ''").groupBy("source").agg(F.count("*").alias("n"))
    return {
        "key_people": people, "timeline_events": _page(events.select("event_date", "context", "confidence", "precision", "doc_title", "document_id", "id"), ["event_date", "id"], limit),
        "financial_summary": money.orderBy(F.col("avg_risk").desc(), "indicator_type"), "sources": _page(sources, [F.col("n").desc(), "source"], 10), **({} if chains is None else {"evidence_chains": chains}),
    }


def provenance_summary(c: Corpus, recent: int = 20) -> dict[str, DataFrame]:
    """Tracked and untracked documents, kinds of provenance events and the last ones."""
    events = c["provenance"]
    tracked = c["docs"].agg(F.count("*").alias("total_documents")).crossJoin(events.agg(F.countDistinct("document_id").alias("tracked_documents")))  # one row each
    titled = events.join(c["docs"].select(F.col("id").alias("document_id"), "title"), "document_id")
    return {
        "summary": tracked.withColumn("untracked", F.col("total_documents") - F.col("tracked_documents")), "event_types": events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "event_type"),
        "recent": _page(titled.select("event_type", "event_date", "description", "actor", "title", "document_id", "created_at"), [F.col("created_at").desc(), "document_id"], recent),
    }


# entities


def _totals(c: Corpus, entities: DataFrame) -> DataFrame:
    n = c.tasks()
    totals = c["mentions"].repartition(n, "entity_id").join(entities.select("id").repartition(n, "id"), F.col("entity_id") == F.col("id"), "left_semi").groupBy("entity_id").agg(F.countDistinct("document_id").alias("doc_count"), F.sum("count").alias("mentions"))
    return entities.join(totals, F.col("id") == F.col("entity_id")).select("id", "name", "type", "doc_count", "mentions")


def list_entities(c: Corpus, type: str | None = None, limit: int | None = 30) -> DataFrame:
    """Most mentioned entities."""
    return _page(_totals(c, _where(c["entities"], _equal("type", type))), [F.col("mentions").desc(), "id"], limit)


def search_entities(c: Corpus, q: str, limit: int | None = 10) -> DataFrame:
    return _page(_totals(c, c["entities"].filter(_holds("name", q))), [F.col("mentions").desc(), "id"], limit)


def entity_documents(c: Corpus, entity_id: int, limit: int | None = 20) -> DataFrame:
    found = c["mentions"].filter(F.col("entity_id") == entity_id).join(c["docs"], F.col("id") == F.col("document_id"))
    return _page(found.select("id", "title", "category", "date", "count"), [F.col("count").desc(), "id"], limit)


def entity_risk(c: Corpus, entity_id: int, limit: int = 10) -> DataFrame:
    """Riskiest documents of an entity."""
    risk = c["facts"].filter(F.col("analysis_type") == "risk_score").select("document_id", "percent")
    return _page(c["mentions"].filter(F.col("entity_id") == entity_id).select("document_id").join(risk, "document_id"), [F.col("percent").desc(), "document_id"], limit)


def entity_connections(c: Corpus, entity_id: int, limit: int | None = 30) -> DataFrame:
    """Entities linked with one, by the weight of the link."""
    ends = pairs.both_ends(c["links"], "entity_a_id", "entity_b_id").filter(F.col("node") == entity_id)
    found = ends.join(c["entities"], F.col("id") == F.col("partner")).select("id", "name", "type", "weight")
    return _page(found, [F.col("weight").desc(), "id"], limit)


def entity_profile(c: Corpus, entity_id: int) -> dict[str, DataFrame]:
    """Documents, risk, timeline, connections and tags of an entity."""
    documents = entity_documents(c, entity_id, None)
    mine = c["mentions"].filter(F.col("entity_id") == entity_id).select("document_id")
    timeline = c["dated"].filter("event_date IS NOT NULL AND confidence >= 0.5").join(mine, "document_id", "left_semi")
    return {
        "entity": c["entities"].filter(F.col("id") == entity_id), "documents": documents, "totals": documents.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_mentions")),
        "risk": entity_risk(c, entity_id), "timeline": _page(timeline.select("id", "event_date", "precision", "confidence", "context", "document_id"), ["event_date", "id"], 50),
        "cooccurring": entity_connections(c, entity_id), "tags": entity_tags(c, entity_id),
    }


def entity_tags(c: Corpus, entity_id: int) -> DataFrame:
    return c["tags"].filter(F.col("entity_id") == entity_id).select("tag").orderBy("tag")


def entities_by_tag(c: Corpus, tag: str) -> DataFrame:
    tagged = c["entities"].join(c["tags"].filter(F.col("tag") == tag), F.col("id") == F.col("entity_id")).select("id", "name", "type")
    totals = c["mentions"].groupBy("entity_id").agg(F.countDistinct("document_id").alias("doc_count"), F.sum("count").alias("mentions"))
    return tagged.join(totals, F.col("id") == F.col("entity_id"), "left").select("id", "name", "type", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


def entity_aliases(c: Corpus, entity_id: int) -> DataFrame:
    return c["aliases"].filter(F.col("entity_id") == entity_id).select("alias_name")


def resolve_alias(c: Corpus, name: str) -> DataFrame:
    """(id, name, type, via): the entity with that alias, else that name; the smallest id of several."""
    aliases = c["aliases"].filter(F.lower("alias_name") == name.lower()).select(F.col("entity_id").alias("id")).join(c["entities"], "id").select("id", "name", "type", F.lit("alias").alias("via"))
    direct = c["entities"].filter(F.lower("name") == name.lower()).select("id", "name", "type", F.lit("direct").alias("via"))
    return aliases.unionByName(direct).orderBy("via", "id").limit(1)


def entity_timeline(c: Corpus, entity_id: int, partners: int = 15) -> dict[str, DataFrame]:
    """Events and documents of an entity in order of time, and the entities that share most documents with it."""
    linked = c["event_entities"].filter(F.col("entity_id") == entity_id).select("event_id")
    events = c["dated"].join(linked, F.col("id") == F.col("event_id"), "left_semi").join(c["docs"].select(F.col("id").alias("document_id"), F.col("title").alias("doc_title")), "document_id", "left")
    documents = c["mentions"].filter(F.col("entity_id") == entity_id).join(c["docs"], F.col("id") == F.col("document_id"))
    return {
        "events": events.select("id", "event_date", "context", "precision", "confidence", "document_id", "doc_title").orderBy("event_date", "id"),
        "documents": documents.select("id", "title", "filename", "category", "date", "source", "count").orderBy("date", "id"), "cooccurring": entity_partners(c, entity_id, partners),
    }


def entity_partners(c: Corpus, entity_id: int, limit: int | None = 15) -> DataFrame:
    """Entities by the number of documents they share with one."""
    mine = c["mentions"].filter(F.col("entity_id") == entity_id).select("document_id").distinct()
    shared = c["mentions"].filter(F.col("entity_id") != entity_id).join(mine, "document_id", "left_semi").groupBy("entity_id").agg(F.countDistinct("document_id").alias("shared"))
    return _page(shared.join(c["entities"], F.col("id") == F.col("entity_id")).select("id", "name", "type", "shared"), [F.col("shared").desc(), "id"], limit)


def merge_preview(c: Corpus, source_id: int, target_id: int) -> DataFrame:
    """One row: documents, mentions, connections and tags of two entities, and what their merger would have."""
    both = F.col("entity_id").isin(source_id, target_id)
    is_source = F.col("entity_id") == source_id
    per = c["mentions"].filter(both).groupBy("document_id").agg(
        F.max(is_source.cast("int")).alias("s"), F.max((~is_source).cast("int")).alias("t"), F.sum(F.when(is_source, F.col("count"))).alias("ms"), F.sum(F.when(~is_source, F.col("count"))).alias("mt")
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    docs = per.agg(
        zero(F.sum("s")).alias("source_docs"), zero(F.sum("t")).alias("target_docs"), zero(F.sum(F.expr("s * t"))).alias("shared"), F.count("*").alias("merged_docs"),
        zero(F.sum("ms")).alias("source_mentions"), zero(F.sum("mt")).alias("target_mentions"),
    )
    ends = pairs.both_ends(c["links"], "entity_a_id", "entity_b_id")
    links = ends.agg(F.expr(f"count_if(node = {int(source_id)})").alias("source_connections"), F.expr(f"count_if(node = {int(target_id)})").alias("target_connections"))
    tags = c["tags"].filter(both).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("merged_tags"))
    return docs.crossJoin(links).crossJoin(tags)  # one row each


def entity_report(c: Corpus, entity_id: int) -> dict[str, DataFrame]:
    """What an exported report of an entity shows: documents, events, associated entities, aliases, tags (``sources.reports.entity_report`` writes it)."""
    mine = c["mentions"].filter(F.col("entity_id") == entity_id).select("document_id")
    events = c["dated"].filter("event_date IS NOT NULL").join(mine, "document_id", "left_semi").select("event_date", "context", "precision", "id")
    return {
        "entity": c["entities"].filter(F.col("id") == entity_id), "Documents": entity_documents(c, entity_id, None), "Timeline": _page(events, ["event_date", "id"], 100).drop("id"),
        "Associated Entities": entity_partners(c, entity_id, 30), "Aliases": entity_aliases(c, entity_id), "Tags": entity_tags(c, entity_id),
    }


# time and connections


def get_timeline(
    c: Corpus, start: str | None = None, end: str | None = None, entity: str | None = None, document_id: int | None = None,
    min_confidence: float = 0.0, include_unresolved: bool = False, limit: int | None = 200,
) -> DataFrame:
    """Events in order of their dates, those without one last."""
    rows = _where(
        c["dated"], None if include_unresolved else F.col("is_resolved"), F.col("confidence") >= min_confidence if min_confidence > 0 else None, None if start is None else F.col("event_date") >= start,
        None if end is None else F.col("event_date") <= end, _equal("document_id", document_id),
    )
    if entity:
        named = c["entities"].filter(_holds("name", entity) | _holds("canonical", entity)).select(F.col("id").alias("entity_id"))
        events = c["event_entities"].join(named, "entity_id", "left_semi").select("event_id")
        rows = rows.join(events, F.col("id") == F.col("event_id"), "left_semi")
    docs = c["docs"].select(F.col("id").alias("document_id"), F.col("title").alias("doc_title"), F.col("category").alias("doc_category"), F.col("source").alias("doc_source"))
    return _page(rows.join(docs, "document_id"), [F.col("event_date").asc_nulls_last(), "id"], limit)


def timeline_overlay(c: Corpus, entity_ids: Sequence[int]) -> DataFrame:
    """(entity_id, id, event_date, precision) of several entities' events."""
    linked = c["event_entities"].filter(F.col("entity_id").isin(list(entity_ids)))
    return linked.join(c["dated"], F.col("id") == F.col("event_id")).select("entity_id", "id", "event_date", "precision").distinct()


def entity_event_dates(c: Corpus, entity_id: int) -> DataFrame:
    """(id, event_date) of the events in an entity's documents."""
    mine = c["mentions"].filter(F.col("entity_id") == entity_id).select("document_id")
    return c["dated"].join(mine, "document_id", "left_semi").select("id", "event_date")


def unresolved_dates(c: Corpus, limit: int | None = 50) -> DataFrame:
    return _page(c["dated"].filter("NOT is_resolved").select("id", "document_id", "context"), ["id"], limit)


def get_connections(c: Corpus, entity_id: int | None = None, min_weight: int = 1, limit: int | None = 50) -> DataFrame:
    """Links by weight, all or those of one entity."""
    links = c["links"].filter(F.col("weight") >= min_weight)
    if entity_id is not None:
        links = links.filter((F.col("entity_a_id") == entity_id) | (F.col("entity_b_id") == entity_id))
    links = _page(links, [F.col("weight").desc(), "entity_a_id", "entity_b_id"], limit)
    for s in "ab":
        links = links.join(c["entities"].select(F.col("id").alias(f"entity_{s}_id"), F.col("name").alias(f"name_{s}"), F.col("type").alias(f"type_{s}")), f"entity_{s}_id")
    return links.orderBy(F.col("weight").desc(), "entity_a_id", "entity_b_id")


# graph


def _graph(c: Corpus, type: str | None = None) -> DataFrame:
    """The canonical graph, written once per corpus and type."""
    if ("graph", type) not in c.kept:
        c.kept["graph", type] = graph.cut(graph.canonical_edges(c["links"], c["entities"], c["resolutions"], type))
    return c.kept["graph", type]


def graph_stats(c: Corpus, type: str | None = None) -> DataFrame:
    return graph.stats(_graph(c, type))


def graph_centrality(c: Corpus, metric: str = "degree", type: str | None = None, limit: int | None = 50) -> DataFrame:
    """(node, name, type, score) by degree, betweenness, closeness or eigenvector centrality, highest first."""
    edges = _graph(c, type)
    if metric in ("betweenness", "closeness"):
        scores = graph.path_centralities(edges).select("node", F.col(metric).alias("score"))
    elif metric in ("degree", "eigenvector"):
        scores = (graph.degree_centrality if metric == "degree" else graph.eigenvector_centrality)(edges).select("node", "score")
    else:
        raise ValueError(f"no metric {metric!r}: degree, betweenness, closeness or eigenvector")
    top = _page(scores, [F.col("score").desc(), "node"], limit)
    return top.join(c["entities"], F.col("id") == F.col("node")).select("node", "name", "type", "score").orderBy(F.col("score").desc(), "node")


def graph_communities(c: Corpus, type: str | None = None, min_size: int = 2) -> dict[str, DataFrame]:
    """Members, and size, density and label of each community; the label names its first three persons, else members; and their shared documents."""
    edges = _graph(c, type)
    members = graph.cut(graph.communities(edges, min_size))
    named = members.join(c["entities"].select(F.col("id").alias("node"), "name", "type"), "node")
    return {"members": named, "communities": graph.described(edges, named), "documents": graph.shared_documents(named, c["mentions"], c["docs"])}


def graph_path(c: Corpus, source: int | str, target: int | str) -> dict[str, DataFrame] | None:
    """Nodes of the strongest path between two entities, given by id or by name, with the documents that each step's ends share; None without one."""
    ends = [_entity(c, x) for x in (source, target)]
    found = None if None in ends else graph.shortest_path(_graph(c), *ends)
    if found is None:
        return None
    steps = c.spark.createDataFrame([(k, n, float(found[1])) for k, n in enumerate(found[0])], "place int, node long, total_weight double")
    hops = c.spark.createDataFrame(list(zip(range(len(found[0]) - 1), found[0], found[0][1:])), "place int, a long, b long")
    m = c["mentions"].select("document_id", "entity_id").distinct()
    a, b = (F.broadcast(hops).join(m, F.col("entity_id") == F.col(s)).select("place", "document_id") for s in "ab")  # a path's steps
    shared = a.join(b, ["place", "document_id"]).join(c["docs"].select(F.col("id").alias("document_id"), "title"), "document_id", "left")
    return {"path": steps.join(c["entities"].select(F.col("id").alias("node"), "name", "type"), "node", "left").orderBy("place"), "documents": shared.select("place", "document_id", "title").orderBy("place", "document_id")}


def _entity(c: Corpus, which: int | str) -> int | None:
    """An entity's id: of that id, else the first whose name is that, else the first whose name holds it."""
    if isinstance(which, int):
        return which
    hit = c["entities"].filter(_holds("name", which)).orderBy((F.lower("name") != which.lower()).cast("int"), "id").first()
    return hit and hit.id


def graph_neighbours(c: Corpus, entity_id: int, hops: int = 1, min_weight: int = 1) -> DataFrame:
    return graph.neighbours(_graph(c), entity_id, hops, min_weight)


def graph_subgraph(c: Corpus, entity_ids: Sequence[int]) -> DataFrame:
    return graph.subgraph(_graph(c), c.spark.createDataFrame([(int(n),) for n in entity_ids], "n long"))


# findings


def resolve_entity(c: Corpus, entity_id: int, index: resolve.NameIndex | None = None, limit: int | None = None) -> DataFrame:
    """Entities that one may be the same as, with their names, likeliest first; from an index of names where one is given, else by a look at all names."""
    own = c["entities"].filter(F.col("id") == entity_id)
    found = resolve.candidates(c["entities"], c["mentions"]).filter((F.col("source") == entity_id) | (F.col("target") == entity_id)) if index is None else index.matches(own, c["mentions"])
    other = F.when(F.col("source") == entity_id, F.col("target")).otherwise(F.col("source")).alias("other")
    named = found.select(other, "confidence", "action").join(c["entities"], F.col("id") == F.col("other"))
    return _page(named.select("id", "name", "type", "confidence", "action"), [F.col("confidence").desc(), "id"], limit)


def resolution_classes(c: Corpus, min_size: int = 2, limit: int | None = 50) -> DataFrame:
    """Names that several entities bear, the most borne first."""
    return _page(resolve.classes(c["entities"]).filter(F.col("size") >= min_size), [F.col("size").desc(), "class_id"], limit)


def detect_anomalies(
    c: Corpus, spike: float = 3.0, least_events: int = 5, least_weight: int = 3, least_indicators: int = 3, least_mentions: int = 10, most_documents: int = 2, now: str | None = None, limit: int | None = 20,
) -> dict[str, DataFrame]:
    """Days with far more events than the mean, pairs that are nearly always together, documents with many financial indicators,
    entities that few documents name often, and what is odd in the metadata of PDF files."""
    days = c["dated"].filter("length(event_date) >= 10 AND confidence >= 0.5").groupBy(F.col("event_date").alias("date")).agg(F.count("*").alias("count"))
    mean = days.agg(F.avg("count").alias("mean"))  # one row
    spikes = days.crossJoin(mean).filter(F.col("count") >= F.greatest(F.col("mean") * spike, F.lit(float(least_events))))
    spikes = spikes.select("date", "count", F.round("mean", 1).alias("avg"), F.round(F.col("count") / F.col("mean"), 1).alias("ratio"))
    e, total = c["entities"].select("id", "name", "type"), c["mentions"].groupBy("entity_id").agg(F.sum("count").alias("total"), F.countDistinct("document_id").alias("doc_count"))
    end = lambda side: e.join(total, F.col("id") == F.col("entity_id"), "left").select(F.col("id").alias(f"entity_{side}_id"), F.col("name").alias(f"name_{side}"), F.col("type").alias(f"type_{side}"), F.coalesce("total", F.lit(1)).alias(f"total_{side}"))
    pairs_of = c["links"].filter(F.col("weight") >= least_weight).join(end("a").filter("type_a = 'person'"), "entity_a_id").join(end("b").filter("type_b IN ('person', 'org', 'place')"), "entity_b_id")
    pairs_of = pairs_of.withColumn("share", F.col("weight") / (F.col("total_a") + F.col("total_b")))
    together = _page(pairs_of, [F.col("share").desc(), "entity_a_id", "entity_b_id"], limit).select("entity_a_id", "entity_b_id", "name_a", "name_b", "type_a", "type_b", F.col("weight").alias("co_occurrences"), F.round(F.col("share") * 100, 1).alias("ratio"))
    money = c["indicators"].groupBy("document_id").agg(F.count("*").alias("indicator_count"), F.round(F.avg("risk"), 3).alias("avg_risk"), F.array_join(F.array_sort(F.collect_set("indicator_type")), ",").alias("types"))
    money = money.filter(F.col("indicator_count") >= least_indicators).join(c["docs"], F.col("id") == F.col("document_id")).select("id", "title", "category", "indicator_count", "avg_risk", "types")
    lone = e.filter("type IN ('person', 'org')").join(total, F.col("id") == F.col("entity_id")).filter((F.col("total") >= least_mentions) & (F.col("doc_count") <= most_documents))
    titled = c["pdf_metadata"].join(c["docs"].select(F.col("id").alias("document_id"), "title"), "document_id", "left")
    return {
        "temporal_spikes": _page(spikes, [F.col("count").desc(), "date"], limit), "entity_anomalies": together,
        "financial_clusters": _page(money, [F.col("indicator_count").desc(), "id"], limit),
        "isolated_entities": _page(lone.select("id", "name", "type", F.col("total").alias("total_mentions"), "doc_count"), [F.col("total_mentions").desc(), "id"], limit),
        "date_inconsistencies": anomaly.date_inconsistencies(c["pdf_metadata"], now or datetime.date.today().isoformat()), "metadata_stripping": anomaly.metadata_stripping(titled),
        "producer_inconsistencies": anomaly.producer_inconsistencies(c["pdf_metadata"]), "creation_clusters": anomaly.creation_clusters(c["pdf_metadata"]),
    }


def fts_stats(c: Corpus) -> dict[str, DataFrame]:
    """How many documents there are, are indexed and have text, and documents with text by category."""
    held = c["docs"].select("id", "category").join(c["texts"].filter("text <> ''").select(F.col("id").alias("hit")), F.col("id") == F.col("hit"), "left")
    indexed = F.lit(c.index.docs) if isinstance(c.index, Fulltext) else F.count("*")
    totals = held.agg(indexed.cast("long").alias("indexed_docs"), F.count("*").alias("total_docs"), F.count("hit").alias("with_text"))
    share = F.when(F.col("total_docs") > 0, F.round(100 * F.col("indexed_docs") / F.col("total_docs"), 1)).otherwise(0.0)
    by = held.filter("hit IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    return {"totals": totals.withColumn("coverage_pct", share), "by_category": _page(by, [F.col("n").desc(), "category"], None)}


def ocr_quality(c: Corpus, doc_id: int | None = None, page: int = 3000) -> DataFrame:
    """(id, page_number, char_count, word_count, quality_score, alpha_ratio, issues) of each page of one text or all.

    Pages are parted by form feeds, else cut every ``page`` characters; a score starts at 1 and is lowered by each issue.
    """
    texts = c["texts"] if doc_id is None else c["texts"].filter(F.col("id") == doc_id)
    pages = rf"""CASE WHEN contains(text, chr(12)) THEN filter(split(text, chr(12)), x -> x RLIKE r'\S') WHEN length(text) > {int(page)} THEN transform(sequence(0, (length(text) - 1) div {int(page)}), k -> substr(text, k * {int(page)} + 1, {int(page)}))
        WHEN text <> '' THEN array(text) ELSE array() END"""
    rows = texts.select("id", F.posexplode(F.expr(pages)).alias("at", "p")).withColumn("chars", F.length("p"))
    per = lambda pattern: F.length(F.regexp_replace("p", pattern, "")) / F.greatest("chars", F.lit(1))
    rows = rows.withColumns({"alpha": per(r"\P{L}"), "space": per("[^ ]"), "garbage": per(r"[\x00-\x7F\p{L}]"), "words": F.size(F.regexp_extract_all("p", F.lit(r"\S+"), F.lit(0))), "solid": F.length(F.regexp_replace("p", r"\s", ""))})
    long = F.col("solid") / F.greatest("words", F.lit(1))
    issues = {"short_text": (F.col("chars") < 50, 0.3), "low_alpha": (F.col("alpha") < 0.4, 0.5), "garbage_chars": (F.col("garbage") > 0.05, 0.4), "spacing_abnormal": ((F.col("space") < 0.05) | (F.col("space") > 0.5), 0.6), "word_length_abnormal": ((long > 15) | (long < 2), 0.5)}
    score = functools.reduce(lambda a, b: a * b, [F.when(found, F.lit(rate)).otherwise(F.lit(1.0)) for found, rate in issues.values()])
    names = F.array_join(F.array_compact(F.array(*(F.when(found, F.lit(name)) for name, (found, _) in issues.items()))), ",")
    return rows.select("id", (F.col("at") + 1).alias("page_number"), F.col("chars").cast("long").alias("char_count"), F.col("words").cast("long").alias("word_count"), F.round(score, 3).alias("quality_score"), F.round("alpha", 3).alias("alpha_ratio"), names.alias("issues"))


#: Route name -> function.
ROUTES: dict[str, Callable] = {n: f for n, f in list(globals().items()) if inspect.isfunction(f) and not n.startswith("_") and f.__module__ == __name__}


def call(c: Corpus, route: str, **arguments):
    """A route by name; unknown routes and arguments raise ``ValueError`` with what there is."""
    if route not in ROUTES:
        raise ValueError(f"no route {route!r}: {', '.join(sorted(ROUTES))}")
    known = list(inspect.signature(ROUTES[route]).parameters)[1:]
    if unknown := set(arguments) - set(known):
        raise ValueError(f"{route} takes {', '.join(known) or 'no arguments'}, not {', '.join(sorted(unknown))}")
    return ROUTES[route](c, **arguments)
