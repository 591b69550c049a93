"""An analyst's workspace: notes, tags, watch lists, boards, chains of evidence, case files, over ``Store`` tables.

Each table has an id given out as one more than the largest; every change is logged in ``audit``.
Reads are DataFrames, joined with the corpus where a view needs names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import phrases
from quaestor.sources.store import Store

#: Tables: schema, and the columns of which a repeated row is left out.
TABLES: dict[str, tuple[str, list[str]]] = {
    "annotations": ("id long, document_id long, start_offset int, end_offset int, text string, note string, created_at string", []),
    "watchlist": ("id long, entity_id long, notes string, created_at string", ["entity_id"]),
    "saved_queries": ("id long, name string, query string, created_at string", []),
    "keyword_alerts": ("id long, keyword string, created_at string", ["keyword"]),
    "analyst_notes": ("id long, document_id long, content string, created_at string", []),
    "search_history": ("id long, query string, result_count long, searched_at string", []),
    "entity_tags": ("id long, entity_id long, tag string", ["entity_id", "tag"]),
    "entity_aliases": ("id long, entity_id long, alias_name string", ["entity_id", "alias_name"]),
    "source_ratings": ("id long, source string, rating string, notes string", ["source"]),
    "board_items": ("id long, item_type string, title string, content string, x double, y double", []),
    "evidence_chains": ("id long, name string, description string", []),
    "evidence_links": ("id long, chain_id long, link_type string, link_id long, narrative string, position int", []),
    "snapshots": ("id long, name string, data string, created_at string", []),
    "case_files": ("id long, name string, description string, status string", []),
    "case_items": ("id long, case_id long, item_type string, item_id long, note string, sort_order int", ["case_id", "item_type", "item_id"]),
    "redactions": ("id long, document_id long, start_offset int, end_offset int, reason string", []),
    "provenance": ("id long, document_id long, event_type string, actor string, details string, created_at string", []),
    "dismissals": ("id long, doc_a long, doc_b long", ["doc_a", "doc_b"]),
    "resolution_queue": ("id long, source_entity_id long, target_entity_id long, confidence double", ["source_entity_id", "target_entity_id"]),
    "resolutions": ("id long, source_entity_id long, canonical_entity_id long", ["source_entity_id"]),
    "audit": ("id long, action string, target_type string, target_id long, details string", []),
}
RATINGS = "ABCDEF"
ITEM_TYPES = ("document", "entity", "chain")


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.stores = {name: Store(spark, f"{self.folder}/{name}", schema) for name, (schema, _) in TABLES.items()}

    def table(self, name: str) -> DataFrame:
        return self.stores[name].read()

    def _next(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def log(self, action: str, kind: str = "", target: int = 0, details: str = "") -> None:
        row = self.spark.createDataFrame([(self._next("audit"), action, kind, target, details)], TABLES["audit"][0])
        self.stores["audit"].append(row)

    def add(self, table: str, /, replace: bool = False, **values) -> int:
        """Appends a row and returns its id; a repeated key is left out, or takes the old row's place."""
        schema, unique = TABLES[table]
        new = self._next(table)
        row = self.spark.createDataFrame([tuple(new if f.split()[0] == "id" else values.get(f.split()[0]) for f in schema.split(", "))], schema)
        if replace and unique:
            self.stores[table].upsert(row, unique)
        else:
            self.stores[table].append(row, unique or None)
        self.log(f"add_{table}", table, new)
        return new

    def remove(self, name: str, row: int) -> None:
        self.stores[name].delete(F.col("id") == row)
        self.log(f"delete_{name}", name, row)

    def change(self, table: str, row: int, /, **values) -> None:
        self.stores[table].update(F.col("id") == row, {k: F.lit(v) for k, v in values.items()})
        self.log(f"update_{table}", table, row)

    def clear(self, name: str) -> None:
        self.stores[name].delete(F.lit(True))

    # -- views and rules of their own

    def rate_source(self, source: str, rating: str, notes: str = "") -> int:
        if rating not in RATINGS or len(rating) != 1:
            raise ValueError(f"a rating is one of {', '.join(RATINGS)}")
        return self.add("source_ratings", replace=True, source=source, rating=rating, notes=notes)

    def tag(self, entity: int, tag: str) -> int:
        return self.add("entity_tags", entity_id=entity, tag=tag.strip().lower())

    def tag_type(self, entities: DataFrame, mentions: DataFrame, kind: str, tag: str, least: int) -> int:
        """Tags every entity of a type with ``least`` mentions or more; returns how many are new."""
        totals = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.sum("count").alias("n")).filter(F.col("n") >= least)
        wanted = entities.filter(F.col("type") == kind).join(totals, "id", "left_semi").select(F.col("id").alias("entity_id"), F.lit(tag.strip().lower()).alias("tag"))
        new = wanted.join(self.table("entity_tags").select("entity_id", "tag"), ["entity_id", "tag"], "left_anti")
        count, base = new.count(), self._next("entity_tags")
        self.stores["entity_tags"].append(new.withColumn("id", F.monotonically_increasing_id() + base))
        self.log("bulk_tag", kind, count, tag)
        return count

    def remember_search(self, query: str, results: int, at: str) -> int | None:
        return self.add("search_history", query=query, result_count=results, searched_at=at) if len(query) >= 2 else None

    def searches(self, k: int = 50) -> DataFrame:
        """(query, n, result_count, searched_at): the latest of each query."""
        h = self.table("search_history").groupBy("query").agg(F.count("*").alias("n"), F.max_by("result_count", "searched_at").alias("result_count"), F.max("searched_at").alias("searched_at"))
        return h.orderBy(F.col("searched_at").desc(), "query").limit(k)

    def watched(self, entities: DataFrame, mentions: DataFrame) -> DataFrame:
        stats = mentions.groupBy(F.col("entity_id")).agg(F.countDistinct("document_id").alias("docs"), F.sum("count").alias("mentions"))
        return self.table("watchlist").join(entities.select(F.col("id").alias("entity_id"), "name", "type"), "entity_id").join(stats, "entity_id", "left").na.fill(0, ["docs", "mentions"])

    def alerts(self, documents: DataFrame, k: int = 20) -> DataFrame:
        """(keyword, id, hits): the ``k`` documents that hold each keyword most often, case as written."""
        from quaestor.operators.pairs import top_per_group

        words = self.table("keyword_alerts").select("keyword").filter("keyword <> ''")
        low = documents.select("id", F.lower("text").alias("text"))
        hits = low.join(F.broadcast(words) if words.count() < 10_000 else words, F.expr("contains(text, lower(keyword))"))
        hits = hits.select("keyword", "id", F.floor((F.length("text") - F.length(F.replace("text", F.lower("keyword"), F.lit("")))) / F.length("keyword")).alias("hits"))
        return top_per_group(hits, ["keyword"], [F.col("hits").desc(), F.col("id")], k).drop("rank")

    def add_link(self, chain: int, kind: str, target: int, narrative: str = "") -> int:
        last = self.table("evidence_links").filter(F.col("chain_id") == chain).agg(F.max("position")).first()[0] or 0
        return self.add("evidence_links", chain_id=chain, link_type=kind, link_id=target, narrative=narrative, position=last + 1)

    def chains(self) -> DataFrame:
        n = self.table("evidence_links").groupBy(F.col("chain_id").alias("id")).agg(F.count("*").alias("links"))
        return self.table("evidence_chains").join(n, "id", "left").na.fill(0, ["links"])

    def chain(self, chain: int, documents: DataFrame, entities: DataFrame) -> DataFrame:
        """The chain's links in order, each with the title or name of what it points to."""
        links = self.table("evidence_links").filter(F.col("chain_id") == chain)
        d = documents.select(F.col("id").alias("link_id"), F.col("title"), F.lit("document").alias("link_type"))
        e = entities.select(F.col("id").alias("link_id"), F.col("name"), F.lit("entity").alias("link_type"))
        return links.join(d, ["link_id", "link_type"], "left").join(e, ["link_id", "link_type"], "left").select("position", "link_type", "link_id", F.coalesce("title", "name").alias("label"), "narrative").orderBy("position")

    def remove_chain(self, chain: int) -> None:
        self.stores["evidence_links"].delete(F.col("chain_id") == chain)
        self.remove("evidence_chains", chain)

    def add_case_item(self, case: int, kind: str, target: int, note: str = "") -> int:
        if kind not in ITEM_TYPES:
            raise ValueError(f"an item is one of {', '.join(ITEM_TYPES)}")
        last = self.table("case_items").filter(F.col("case_id") == case).agg(F.max("sort_order")).first()[0] or 0
        return self.add("case_items", case_id=case, item_type=kind, item_id=target, note=note, sort_order=last + 1)

    def cases(self) -> DataFrame:
        n = self.table("case_items").groupBy(F.col("case_id").alias("id")).pivot("item_type", list(ITEM_TYPES)).count()
        return self.table("case_files").join(n, "id", "left").na.fill(0, list(ITEM_TYPES))

    def remove_case(self, case: int) -> None:
        self.stores["case_items"].delete(F.col("case_id") == case)
        self.remove("case_files", case)

    def snapshot(self, name: str, at: str, **counts: int) -> int:
        """Keeps the watch list, tags and given counts as JSON."""
        data = self.spark.range(1).select(
            F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in counts.items()], F.lit(None).cast("string").alias("_"))).alias("counts")
        ).crossJoin(self.table("watchlist").agg(F.sort_array(F.collect_list("entity_id")).alias("watchlist"))).crossJoin(self.table("entity_tags").agg(F.sort_array(F.collect_list(F.struct("entity_id", "tag"))).alias("tags")))
        return self.add("snapshots", name=name, data=data.select(F.to_json(F.struct("counts", "watchlist", "tags"))).first()[0], created_at=at)

    def redacted_text(self, documents: DataFrame) -> DataFrame:
        """(id, text): spans, clamped to the text and merged where they overlap, replaced by [REDACTED]."""
        return phrases.redacted(documents, self.table("redactions")).select("id", "text")

    def dismiss(self, a: int, b: int) -> int:
        return self.add("dismissals", doc_a=min(a, b), doc_b=max(a, b))

    def review(self, row: int, approve: bool) -> None:
        """Takes a pair off the queue; approved ones become resolutions."""
        pair = self.table("resolution_queue").filter(F.col("id") == row).first()
        if pair is None:
            raise KeyError(row)
        if approve:
            self.add("resolutions", replace=True, source_entity_id=pair.source_entity_id, canonical_entity_id=pair.target_entity_id)
        self.remove("resolution_queue", row)

    def split(self, source: int, target: int) -> None:
        self.stores["resolutions"].delete((F.col("source_entity_id") == source) & (F.col("canonical_entity_id") == target))
        self.log("split", "entity", source)


def merge_entities(entities: DataFrame, mentions: DataFrame, links: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with ``source`` folded into ``target``: counts of shared documents and weights of meeting edges are summed."""
    to = lambda c: F.when(F.col(c) == source, F.lit(target)).otherwise(F.col(c)).cast("long")
    m = mentions.select("document_id", to("entity_id").alias("entity_id"), "count").groupBy("document_id", "entity_id").agg(F.sum("count").alias("count"))
    a, b, w = links.columns
    e = links.select(to(a).alias("x"), to(b).alias("y"), w).filter("x <> y").groupBy(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b)).agg(F.sum(w).alias(w))
    return entities.filter(F.col("id") != source), m, e


def bulk_tag(docs: DataFrame, ids: list[int], tag: str = "", category: str = "") -> tuple[DataFrame, int]:
    """(documents, changes): the ``ids`` get a category, and a mark [tag:...] at the end of their notes unless they have it; ids that do not exist do not count.

    ``ValueError`` without ids, or without both tag and category.
    """
    tag, category = tag.strip(), category.strip()
    if not ids or not (tag or category):
        raise ValueError("name ids, and a tag or a category")
    chosen, mark = F.col("id").isin(ids), f"[tag:{tag}]"
    notes = F.coalesce("notes", F.lit(""))
    tagged = chosen & F.lit(bool(tag)) & ~F.contains(notes, F.lit(mark))
    counts = docs.agg(F.coalesce(F.sum(tagged.cast("int")), F.lit(0)), F.coalesce(F.sum((chosen & F.lit(bool(category))).cast("int")), F.lit(0))).first()
    new = docs.withColumn("notes", F.when(tagged, F.btrim(F.concat(notes, F.lit(" " + mark)))).otherwise(F.col("notes")))
    return (new.withColumn("category", F.when(chosen, F.lit(category)).otherwise(F.col("category"))) if category else new), counts[0] + counts[1]
