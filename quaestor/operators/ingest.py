"""From files and mails to the tables of a corpus: extraction, classification, entities, events, forensics, keywords.

Every table is a folder of versions.  A batch writes a version of its own into each of them, the
postings of its documents and the change it makes to the counts of entity pairs; then one entry of a
small table, the catalog, makes all of it count at once.  A batch that failed half way has left
folders that nothing names; doing it again, or doing a batch anew, replaces its entry.  A document
that another batch holds is left out.  Ids are hashes of contents and names, so nothing is numbered
in one place, and the same file has the same id wherever it comes from; mails go by message id.

The cost of a batch follows the batch: only its own documents are joined with each other, and pairs
are counted by adding.  ``rewrite`` turns many small versions into one, so that a read opens a bounded
number of folders; it runs by itself beyond ``MOST``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quaestor.bindings import COLUMNS, Corpus
from quaestor.functions import fulltext, mail, names, phrases, timeline
from quaestor.operators.graph import cut
from quaestor.operators.pairs import co_occurrence
from quaestor.plans import texts as plans
from quaestor.sources import files
from quaestor.sources.store import Store

#: Texts of fewer characters are not analysed.
LEAST = 50
_EXTRA = {
    "phrases": "document_id long, phrase string, count long", "codewords": "document_id long, word string, count long, note string, context string",
    "outcomes": "path string, name string, method string, outcome string, document_id long, n_chars long",
}
TABLES = ["texts", "entities", "mentions", "dated", "event_entities", "facts", "indicators", "keywords", "phrases", "codewords", "pdf_metadata", "outcomes", "docs"]
#: Versions that a read opens before they are rewritten as one.
MOST = 32
#: One row a batch (``rows``), one for each change of pair counts (``pairs``), one for each removed document (``gone``).
CATALOG = "kind string, batch string, version string, doc long, docs long, words map<string,long>"
OUTCOMES = ["read", "duplicate", "too short", "broken", "unsupported"]


def _key(*columns: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def safe_name(name: str) -> str:
    """A file name of letters, digits, dots, dashes and underscores, without folders and leading dots; never empty."""
    kept: list[str] = []
    for c in name or "":
        if c in "/\\":
            kept.clear()  # what came before was a folder
        elif c.isascii() and (c.isalnum() or c == "-") or c == "." and kept:
            kept.append(c)
        elif c != "." and kept[-1:] != ["_"]:
            kept.append("_")
    base, dot, end = "".join(kept).rpartition(".")
    base, end = ((base, end) if dot else (end, ""))
    return (base.strip("_") or "upload") + (f".{end.strip('_')}" if end.strip("_") else "")


def inside(folder: str, allowed: list[str]) -> str:
    """The folder's real path if it lies in an allowed one; ``PermissionError`` else."""
    import os

    real = os.path.realpath(folder)
    if any(real == (base := os.path.realpath(a)) or real.startswith(base.rstrip(os.sep) + os.sep) for a in allowed):
        return real
    raise PermissionError(f"{folder} lies in no allowed folder")


def analyzed(spark: SparkSession, texts: DataFrame) -> dict[str, DataFrame]:
    """Forensic tables of texts (id, filename, text): facts, indicators, phrases, code words and categories.

    A text of fewer than ``LEAST`` characters has a risk of 0 and nothing else.
    """
    sound = texts.filter(F.length(F.trim("text")) >= LEAST)
    c = Corpus.of(spark, {})
    c._made["samples"] = sound.select("id", "filename", "text")
    run = lambda name: c.sql(plans.PLANS[name])
    percent = lambda x: F.round(F.col(x) * 100).cast("long").alias("percent")
    one = lambda df, kind, label, share, severity: df.select(F.col("id").alias("document_id"), F.lit(kind).alias("analysis_type"), label.alias("label"), share, severity.alias("severity"))
    info, words = F.lit("info"), phrases.codewords(sound)
    risk = texts.select("id").join(run("compute_risk_score"), "id", "left").withColumn("risk", F.coalesce("risk", F.lit(0.0)))
    level = F.when(F.col("risk") >= 0.7, "high").when(F.col("risk") >= 0.4, "medium").otherwise("low")
    facts = (
        one(run("classify_intent"), "intent", F.col("label"), percent("score"), info)
        .unionAll(one(run("classify_topics"), "topic", F.col("label"), percent("score"), info))
        .unionAll(one(run("detect_aml_flags"), "aml_flag", F.col("flag"), F.expr("CASE severity WHEN 'high' THEN 90L WHEN 'medium' THEN 60L ELSE 30L END AS percent"), F.col("severity")))
        .unionAll(one(words, "codeword", F.col("word"), F.lit(50).cast("long").alias("percent"), F.lit("medium")))
        .unionAll(one(risk, "risk_score", F.lit("overall"), percent("risk"), level))
    )
    money = run("extract_financial_indicators").select(F.col("id").alias("document_id"), F.col("type").alias("indicator_type"), "value", F.col("percent").cast("long").alias("risk"))
    return {
        "facts": facts, "indicators": money, "codewords": words.select(F.col("id").alias("document_id"), "word", "count", "note", "context"),
        "phrases": phrases.repeated_phrases(sound).select(F.col("id").alias("document_id"), "phrase", "count"),
        "categories": texts.select("id").join(run("classify_document"), "id", "left").select("id", F.coalesce("category", F.lit("other")).alias("category")),
    }


def tables(rows: DataFrame, at: str, gazetteers: dict[str, list[str]] | None = None, source: str = "", limits: files.Limits = files.Limits(), least: int = 20) -> dict[str, DataFrame]:
    """All tables (``TABLES``) of files (path, content); ``at`` is the time of ingestion, yyyy-MM-dd HH.  ``outcomes`` has a row for whatever was found in them."""
    every = cut(files.extracted(rows, limits).withColumn("id", _key("file_hash")))
    long_enough = F.length("text") >= least
    found = every.filter(long_enough).groupBy("id").agg(F.min(F.struct("path", "name", "pages", "text", "file_hash")).alias("m")).select("id", "m.*")
    found = cut(found.select("id", "file_hash", "path", F.col("name").alias("filename"), F.col("pages").cast("long").alias("pages"), "text"))
    first = found.select("id", F.col("path").alias("first_path"), F.col("filename").alias("first_name"))
    failed = F.col("method").isin("broken", "encrypted", "pdf_encrypted")
    outcome = F.when(failed, "broken").when(F.col("method").isin("unsupported", "image", "pdf_without_text", "too_deep", "too_large"), "unsupported").when(~long_enough, "too short")
    outcome = outcome.when((F.col("path") == F.col("first_path")) & (F.col("name") == F.col("first_name")), "read").otherwise("duplicate")
    outcomes = every.join(first, "id", "left").select("path", "name", "method", outcome.alias("outcome"), F.when(F.col("first_path").isNotNull(), F.col("id")).alias("document_id"), F.length("text").cast("long").alias("n_chars"))
    named = names.extract_entities(found, gazetteers).select("document_id", "name", "type", F.col("count").cast("long").alias("count"))
    paths = found.select("path", F.col("id").alias("document_id"))
    meta = files.pdf_metadata(rows).join(paths, "path").select("document_id", "author", "creator", "producer", "creation_date", "modification_date", "encrypted")
    return _analysed(found, cut(named), at, source) | {"outcomes": outcomes, "pdf_metadata": meta}


def mail_tables(mails: DataFrame, at: str, gazetteers: dict[str, list[str]] | None = None, source: str = "", collection: str = "", least: int = 10) -> dict[str, DataFrame]:
    """All tables of mails (``files.EMAIL``): one document a message id (a mail without one goes by its contents), whatever file and batch it comes from.

    The text is headers, body and names of attachments; the title is the subject; entities are those of the body and, added
    to them, the people and organisations of the headers.
    """
    people = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.lit(" <"), F.coalesce(p["addr"], F.lit("")), F.lit(">"))), ", ")
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    sender = F.when(F.coalesce("from_addr", F.lit("")) != "", F.concat(F.coalesce("from_name", F.lit("")), F.lit(" <"), F.col("from_addr"), F.lit(">")))
    head = F.concat_ws("\n", line("Subject", F.col("subject")), line("From", sender), line("TO", people(F.col("to"))), line("CC", people(F.col("cc"))), line("Date", F.col("date")))
    body = F.coalesce("body", F.lit(""))
    attached = F.when(F.size(F.coalesce("attachments", F.array())) > 0, F.concat(F.lit("\n\nAttachments: "), F.array_join("attachments", ", "))).otherwise("")
    text = F.concat(head, F.lit("\n\n"), body, attached)
    identity = F.sha2(F.coalesce(F.nullif(F.col("message_id"), F.lit("")), F.concat(head, F.lit("\n\n"), body)), 256)
    every = cut(mails.withColumns({"body": body, "text": text, "file_hash": identity}).withColumn("id", _key(F.lit("mail"), "file_hash")))
    long_enough = F.length(F.trim("text")) >= least
    kept = ["path", "subject", "from_name", "from_addr", "to", "cc", "date", "body", "text", "file_hash"]
    once = cut(every.filter(long_enough).groupBy("id").agg(F.min(F.struct(*kept)).alias("m")).select("id", "m.*"))
    titled = F.coalesce(F.nullif(F.trim("subject"), F.lit("")), F.concat(F.lit("Email from "), F.coalesce(F.nullif(F.col("from_name"), F.lit("")), "from_addr", F.lit("unknown"))))
    found = cut(once.select(
        "id", "file_hash", "path", F.concat(F.lit("email_"), F.substring("file_hash", 1, 12)).alias("filename"), F.lit(1).cast("long").alias("pages"), "text",
        F.concat(F.lit(f"[{collection}] " if collection else ""), titled).alias("title"), F.lit("email").alias("category"), mail.mail_day(F.col("date")).alias("date"),
    ))
    inside_body = names.extract_entities(once.select("id", "body"), gazetteers, text="body").select("document_id", "name", "type", F.col("count").cast("long").alias("count"))
    heads = mail.header_entities(once, "id").select(F.col("key").alias("document_id"), "name", "type", "count")
    merged = inside_body.unionByName(heads).groupBy("document_id", "type", F.lower(F.trim("name")).alias("k")).agg(F.min("name").alias("name"), F.sum("count").alias("count")).drop("k")
    outcome = F.when(~long_enough, "too short").when(F.row_number().over(_by_path()) == 1, "read").otherwise("duplicate")
    outcomes = every.select("path", F.col("subject").alias("name"), F.lit("email").alias("method"), outcome.alias("outcome"), F.when(long_enough, F.col("id")).alias("document_id"), F.length("text").cast("long").alias("n_chars"))
    spark = mails.sparkSession
    return _analysed(found, cut(merged), at, source or collection or "Email Import") | {"outcomes": outcomes, "pdf_metadata": spark.createDataFrame([], COLUMNS["pdf_metadata"])}


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy("id").orderBy("path")


def _analysed(found: DataFrame, named: DataFrame, at: str, source: str) -> dict[str, DataFrame]:
    """Tables of documents (id, file_hash, filename, pages, text; title, category and date where they are known) and their names (document_id, name, type, count)."""
    mentioned = named.withColumn("entity_id", _key("type", F.lower("name")))
    entities = mentioned.groupBy(F.col("entity_id").alias("id"), "type").agg(F.min("name").alias("name")).select("id", "name", "type", F.lower("name").alias("canonical"))
    events = cut(timeline.extract_events(found, named.select("document_id", "name")).withColumn("id", _key("document_id", "source_start", "source_end")))
    by_name = mentioned.select("document_id", "name", "entity_id")
    linked = events.select("id", "document_id", F.explode("names").alias("name")).join(by_name, ["document_id", "name"]).select("document_id", F.col("id").alias("event_id"), "entity_id").distinct()
    forensic = analyzed(found.sparkSession, found)
    day = events.filter("precision = 'day' AND is_resolved").groupBy("document_id").agg(F.min("event_date").alias("first_date"))
    hour = F.substring(F.lit(at), 12, 2).cast("long")
    given = lambda c, other: F.col(c) if c in found.columns else other
    docs = found.join(forensic["categories"].withColumnRenamed("category", "found_category"), "id").join(day, F.col("id") == F.col("document_id"), "left").select(
        "id", "filename", given("title", phrases.title(F.col("text"), F.col("filename"))).alias("title"), given("category", F.col("found_category")).alias("category"), F.lit(source).alias("source"),
        F.coalesce(given("date", F.col("first_date")), F.lit("")).alias("date"), "pages", "file_hash", F.lit(False).alias("flagged"), F.substring(F.lit(at), 1, 10).alias("ingest_day"),
        F.coalesce(hour, F.lit(0)).alias("ingest_hour"), F.lit("").alias("notes"), F.length("text").cast("long").alias("n_chars"),
    )
    return {
        "docs": docs, "texts": found.select("id", "text", F.lit("").alias("lang"), F.lit(source).alias("source"), F.length("text").cast("long").alias("n_chars")), "entities": entities,
        "mentions": mentioned.groupBy("document_id", "entity_id").agg(F.sum("count").cast("long").alias("count")),
        "dated": events.select("id", "document_id", "event_date", "precision", "confidence", "is_resolved", "context"), "event_entities": linked,
        "keywords": phrases.keywords(found).select(F.col("id").alias("document_id"), "word", "count"), **{k: v for k, v in forensic.items() if k != "categories"},
    }


# the catalog


def _catalog(spark: SparkSession, folder: str) -> Store:
    return Store(spark, f"{folder}/catalog", CATALOG)


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog as it is now, kept apart from later changes."""
    return cut(_catalog(spark, folder).read().coalesce(1))


def _schema(name: str) -> str:
    more = {"postings": fulltext.POSTINGS + ", shelf int", "event_entities": "document_id long, " + COLUMNS["event_entities"]}
    return more.get(name) or (COLUMNS | _EXTRA)[name]


def _key_of(name: str) -> str | None:
    return {"docs": "id", "texts": "id", "postings": "doc_id", "entities": None}.get(name, "document_id")


def _rows(spark: SparkSession, folder: str, name: str, catalog: DataFrame, batches: Column | None = None) -> DataFrame:
    """The rows of a table that count, with their ``batch``; of some batches where a condition on the catalog's rows is given."""
    live = catalog.filter(F.col("kind") == "rows")
    live = cut((live if batches is None else live.filter(batches)).select("batch", "version"))
    versions = [r.version for r in live.select("version").distinct().collect()]  # as many as folders are opened
    schema = _schema(name) + ", batch string"
    if not versions:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", version string").option("basePath", f"{folder}/{name}").parquet(*(f"{folder}/{name}/version={v}" for v in versions))
    rows = rows.join(F.broadcast(live), ["batch", "version"], "left_semi").drop("version")  # a row a batch
    key = _key_of(name)
    if key:
        gone = catalog.filter(F.col("kind") == "gone").select("batch", F.col("doc").alias(key))
        rows = rows.join(gone, ["batch", key], "left_anti")
    return rows


def _sums(spark: SparkSession, folder: str, versions: list[str]) -> DataFrame:
    """(a, b, weight) of changes added up; pairs that have come to nothing are left out."""
    schema = "a long, b long, weight long"
    if not versions:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*(f"{folder}/pairs/version={v}" for v in versions))
    return rows.groupBy("a", "b").agg(F.sum("weight").alias("weight")).filter(F.col("weight") != 0)


def _pair_versions(catalog: DataFrame) -> list[str]:
    return [r.version for r in catalog.filter(F.col("kind") == "pairs").select("version").collect()]  # as many as folders are opened


def connections(spark: SparkSession, folder: str) -> DataFrame:
    """(a, b, weight): entities a < b and the number of documents that hold both, from the maintained counts."""
    return _sums(spark, folder, _pair_versions(_entries(spark, folder)))


def _negative(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("weight", -F.col("weight"))


def _write_pairs(change: DataFrame, folder: str, version: str) -> None:
    shares = max(1, int(change.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    change.groupBy("a", "b").agg(F.sum("weight").alias("weight")).filter(F.col("weight") != 0).repartition(shares, "a", "b").sortWithinPartitions("a", "b").write.parquet(f"{folder}/pairs/version={version}")


def write_batch(made: dict[str, DataFrame], folder: str, batch: str, most: int = MOST) -> int:
    """Writes the tables of a batch, without documents of other batches; returns the number of new documents."""
    return batch_totals(made, folder, batch, most)["documents"]


def batch_totals(made: dict[str, DataFrame], folder: str, batch: str, most: int = MOST) -> dict[str, int]:
    """``write_batch``, and what became of each thing found: numbers by outcome, observed while the table of outcomes is written."""
    spark, version = made["docs"].sparkSession, uuid.uuid4().hex
    catalog = _catalog(spark, folder)
    before = _entries(spark, folder)
    mine, others = F.col("batch") == batch, F.col("batch") != batch
    current = [r.version for r in before.filter((F.col("kind") == "rows") & mine).select("version").collect()]
    known = _rows(spark, folder, "docs", before, others).select("id").distinct()
    new = cut(made["docs"].select("id").join(known, "id", "left_anti"))
    seen = Observation()
    for name in TABLES:
        table, key = made[name], _key_of(name)
        if name == "outcomes":
            is_new = new.select(F.col("id").alias("document_id"), F.lit(True).alias("new"))
            held = F.when((F.col("outcome") == "read") & F.col("new").isNull(), "duplicate").otherwise(F.col("outcome"))
            table = table.join(is_new, "document_id", "left").withColumn("outcome", held)
            table = table.observe(seen, *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES), F.count(F.lit(1)).alias("found"))
        elif key:
            table = table.join(new.select(F.col("id").alias(key)), key, "left_semi")
        columns = [c.strip().split(" ")[0] for c in _schema(name).split(", ")]
        table.select(*columns, F.lit(batch).alias("batch")).write.parquet(f"{folder}/{name}/version={version}")
    own = lambda name: spark.read.schema(_schema(name) + ", batch string").parquet(f"{folder}/{name}/version={version}")
    documents = own("docs").join(own("texts").select("id", "text"), "id", "left")
    size = own("docs").agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0]
    fulltext.write_postings(fulltext.postings(documents).withColumn("batch", F.lit(batch)), f"{folder}/postings/version={version}", size)
    words = {f: w for f, (_, w) in fulltext.extents(own("postings")).items()}
    replaced = _rows(spark, folder, "mentions", before, mine)
    _write_pairs(co_occurrence(own("mentions"), "document_id", "entity_id").unionByName(_negative(co_occurrence(replaced, "document_id", "entity_id"))), folder, version)
    docs = own("docs").count()
    pairs = spark.read.parquet(f"{folder}/pairs/version={version}").count()
    entries = spark.createDataFrame([("rows", batch, version, None, docs, words), ("pairs", batch, version, None, pairs, None)], CATALOG)

    def change(t: DataFrame) -> DataFrame:
        if sorted(r.version for r in t.filter((F.col("kind") == "rows") & mine).select("version").collect()) != sorted(current):
            raise RuntimeError(f"another writer did batch {batch} meanwhile: do it again")
        return t.filter(~(mine & F.col("kind").isin("rows", "gone"))).unionByName(entries)

    catalog.change(change)
    rewrite(spark, folder, most)
    return {"documents": docs, **{k: int(v or 0) for k, v in seen.get.items()}}


def remove(spark: SparkSession, folder: str, ids: DataFrame) -> int:
    """Documents with these ids (``id``) no longer count, nor do their words, mentions and pairs; returns how many there were."""
    catalog, version = _catalog(spark, folder), uuid.uuid4().hex
    before = _entries(spark, folder)
    wanted = ids.select(F.col("id").cast("long").alias("id")).distinct()
    lengths = _rows(spark, folder, "postings", before).filter(F.col("shelf") == fulltext.LENGTHS).join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    gone = lengths.groupBy("batch", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("field_words").cast("long").alias("words")))).alias("words"))  # a few fields a document
    gone = cut(gone.select(F.lit("gone").alias("kind"), "batch", F.lit(None).cast("string").alias("version"), F.col("doc_id").alias("doc"), F.lit(1).cast("long").alias("docs"), "words"))
    mentions = _rows(spark, folder, "mentions", before).join(gone.select(F.col("doc").alias("document_id")), "document_id", "left_semi")
    _write_pairs(_negative(co_occurrence(mentions, "document_id", "entity_id")), folder, version)
    entry = spark.createDataFrame([("pairs", "", version, None, spark.read.parquet(f"{folder}/pairs/version={version}").count(), None)], CATALOG)

    def change(t: DataFrame) -> DataFrame:
        same = lambda c: c.filter(F.col("kind") != "pairs").select("kind", "batch", "version", "doc")
        if same(t).exceptAll(same(before)).head(1) or same(before).exceptAll(same(t)).head(1):
            raise RuntimeError("another writer changed the corpus meanwhile: do it again")
        return t.unionByName(gone).unionByName(entry)

    catalog.change(change)
    return gone.count()


def rewrite(spark: SparkSession, folder: str, most: int = MOST) -> bool:
    """Where more than ``most`` versions count, the smaller half of them becomes one, without what no longer counts; the same for the changes of pairs.

    Batches keep their names, so that each can still be replaced.  True if something was rewritten.
    """
    catalog = _catalog(spark, folder)
    before = _entries(spark, folder)
    sizes = before.filter(F.col("kind") == "rows").groupBy("version").agg(F.sum("docs").alias("docs")).orderBy("docs", "version").collect()  # as many as folders are opened
    done = False
    if len(sizes) > most:
        old, version = [r.version for r in sizes[: len(sizes) - most // 2]], uuid.uuid4().hex
        some = F.col("version").isin(old)
        size = 0
        for name in [*TABLES, "postings"]:
            rows = _rows(spark, folder, name, before, some)
            if name == "postings":
                fulltext.write_postings(rows.drop("shelf"), f"{folder}/postings/version={version}", size)
            else:
                rows.write.parquet(f"{folder}/{name}/version={version}")
            if name == "docs":
                size = spark.read.parquet(f"{folder}/docs/version={version}").agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0]
        settled = cut(before.filter(F.col("kind") == "gone").join(before.filter((F.col("kind") == "rows") & some).select("batch"), "batch", "left_semi"))
        lost = settled.groupBy("batch").agg(F.sum("docs").alias("lost"), *(F.sum(F.coalesce(F.col("words")[f], F.lit(0))).alias(f"lost_{f}") for f in fulltext.FIELDS))

        def change(t: DataFrame) -> DataFrame:
            moved = t.filter((F.col("kind") == "rows") & some).join(lost, "batch", "left")
            less = lambda c, x: F.col(c) - F.coalesce(F.col(x), F.lit(0))
            words = F.create_map(*(x for f in fulltext.FIELDS for x in (F.lit(f), F.coalesce(F.col("words")[f], F.lit(0)) - F.coalesce(F.col(f"lost_{f}"), F.lit(0)))))
            moved = moved.select("kind", "batch", F.lit(version).alias("version"), "doc", less("docs", "lost").alias("docs"), words.alias("words"))
            stays = t.filter(~((F.col("kind") == "rows") & some))
            replaced = moved.select("batch")
            dropped = settled.join(replaced, "batch", "left_semi").select("kind", "batch", "doc")
            return stays.join(dropped, ["kind", "batch", "doc"], "left_anti").select(*t.columns).unionByName(moved)

        catalog.change(change)
        done = True
    changes = before.filter(F.col("kind") == "pairs").select("version", "docs").orderBy("docs", "version").collect()
    if len(changes) > most:
        old, total = [r.version for r in changes[: len(changes) - most // 2]], uuid.uuid4().hex
        _write_pairs(_sums(spark, folder, old), folder, total)
        entry = spark.createDataFrame([("pairs", "", total, None, spark.read.parquet(f"{folder}/pairs/version={total}").count(), None)], CATALOG)
        catalog.change(lambda t: t.filter(~((F.col("kind") == "pairs") & F.col("version").isin(old))).unionByName(entry))
        done = True
    return done


def vacuum(spark: SparkSession, folder: str) -> int:
    """Deletes folders of versions that the catalog does not name; no batch may be under way.  Returns how many."""
    catalog = _catalog(spark, folder)
    named = {r.version for r in catalog.read().select("version").distinct().collect()}
    n = 0
    for name in [*TABLES, "postings", "pairs"]:
        where = catalog.path(f"{folder}/{name}")
        for status in catalog.fs.listStatus(where) if catalog.fs.exists(where) else []:
            if status.getPath().getName().removeprefix("version=") not in named:
                catalog.fs.delete(status.getPath(), True)
                n += 1
    return n


def index(spark: SparkSession, folder: str) -> fulltext.Fulltext:
    """The full-text index over title, text, category and source of all documents that count."""
    catalog = _entries(spark, folder)
    signed = F.when(F.col("kind") == "gone", -1).otherwise(1)
    total = catalog.filter("kind IN ('rows', 'gone')").agg(F.sum(signed * F.col("docs")).alias("docs"), *(F.sum(signed * F.coalesce(F.col("words")[f], F.lit(0))).alias(f) for f in fulltext.FIELDS)).first()
    return fulltext.Fulltext(_rows(spark, folder, "postings", catalog), int(total.docs or 0), {f: int(total[f] or 0) for f in fulltext.FIELDS})


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each thing found, by batch: path, name, method, outcome, document_id, n_chars, batch."""
    catalog = _entries(spark, folder)
    return _rows(spark, folder, "outcomes", catalog.filter(F.col("kind") == "rows"))


def ingest(spark: SparkSession, source_folder: str, folder: str, *, batch: str, at: str, **options) -> int:
    """Reads the files below ``source_folder`` into the tables of ``folder``; the same ``batch`` again replaces it."""
    return write_batch(tables(files.files(spark, source_folder), at, **options), folder, batch)


def ingest_mails(spark: SparkSession, source_folder: str, folder: str, *, batch: str, at: str, **options) -> int:
    """Reads the mails below ``source_folder`` into the tables of ``folder``; a mail that another batch holds is left out."""
    return write_batch(mail_tables(files.mails(files.files(spark, source_folder)), at, **options), folder, batch)


def corpus(spark: SparkSession, folder: str) -> Corpus:
    """The tables of all batches that count, with their connections and their full-text index."""
    catalog = _entries(spark, folder)
    out = {}
    for name in TABLES:
        rows = _rows(spark, folder, name, catalog).drop("batch")
        if name == "entities":  # the same name in several batches
            rows = rows.groupBy("id").agg(*(F.min(c).alias(c) for c in ("name", "type", "canonical")))
        out[name] = rows
    out["links"] = _sums(spark, folder, _pair_versions(catalog)).toDF("entity_a_id", "entity_b_id", "weight")
    made = Corpus.of(spark, {k: v for k, v in out.items() if k in COLUMNS})
    made._made |= {k: out[k] for k in _EXTRA}
    made.index = index(spark, folder)
    return made


def _stream_name(spark: SparkSession, checkpoint: str, folder: str) -> str:
    """A name that the stream keeps in its checkpoint, with the corpus it writes to; ``ValueError`` where that is another."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/corpus")
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        out = fs.create(where, False)
        out.write(bytearray(f"{uuid.uuid4().hex} {folder.rstrip('/')}\n".encode()))
        out.close()
    file = fs.open(where)
    try:
        name, of = file.readLine().split(" ", 1)
    finally:
        file.close()
    if of != folder.rstrip("/"):
        raise ValueError(f"the checkpoint belongs to a stream into {of}")
    return name


def streaming_ingest(spark: SparkSession, source_folder: str, folder: str, checkpoint: str, at: Callable[[], str], mails: bool = False, **options):
    """A stream that reads files (or the mails in them) as they arrive; progress lies in ``checkpoint``, and a repeated micro-batch replaces itself.

    Batches are named by the stream, whose name lies in the checkpoint, so that several streams may fill one corpus.
    """
    rows = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(source_folder)
    name = _stream_name(spark, checkpoint, folder)

    def each(df: DataFrame, epoch: int) -> None:
        rows = df.select("path", "content")
        write_batch(mail_tables(files.mails(rows), at(), **options) if mails else tables(rows, at(), **options), folder, f"stream-{name}-{epoch}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)


def upload(spark: SparkSession, name: str, content: bytes, uploads: str, folder: str, *, at: str, **options) -> int:
    """Keeps one file given as bytes under a safe name in ``uploads`` and reads it into the tables of ``folder``; the number of new documents."""
    import hashlib

    digest = hashlib.sha256(content).hexdigest()[:16]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{uploads}/{digest}/{safe_name(name)}")
    out = where.getFileSystem(conf).create(where, True)
    out.write(bytearray(content))
    out.close()
    return ingest(spark, f"{uploads}/{digest}", folder, batch=f"upload-{digest}", at=at, **options)
