"""The document-intelligence tables, bound to the standard relational tables.

Each binding is a DataFrame built here and, for the oracle, the same table as SQL text.  Plans
name bindings in braces (``{docs}``); ``Corpus.sql`` runs a plan over the DataFrames as views,
``oracle`` turns it into one statement with the bindings it needs as common table expressions.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import matcher, text

#: Category of an order priority, extension of an order key: fixed values of the binding.
CATEGORIES = {"1-URGENT": "deposition", "2-HIGH": "report", "3-MEDIUM": "legal", "4-NOT SPECIFIED": "correspondence", "5-LOW": "flight"}
EXTENSIONS = ["pdf", "txt", "eml", "csv"]
TYPES = ["person", "place", "org", "date"]

_CATEGORY_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + " ELSE 'other' END"
_TYPE_SQL = "CASE p_partkey % 4 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TYPES)) + " END"

ORACLE: dict[str, str] = {
    "docs": f"""SELECT o_orderkey AS id, 'order_' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.eml' ELSE '.csv' END AS filename,
        {_CATEGORY_SQL} || ' of ' || c_name AS title, {_CATEGORY_SQL} AS category, n_name AS source, strftime(o_orderdate, '%Y-%m-%d') AS date,
        coalesce(lines, 0)::BIGINT AS pages, 'h' || (o_custkey * 16 + coalesce(lines, 0)) AS file_hash, o_orderstatus = 'F' AS flagged,
        strftime(o_orderdate + (o_orderkey % 5)::INT * INTERVAL 1 DAY, '%Y-%m-%d') AS ingest_day, (o_orderkey % 24)::BIGINT AS ingest_hour,
        CASE WHEN o_orderkey % 7 = 0 THEN 'checked [tag:' || lower(c_mktsegment) || ']' ELSE '' END AS notes,
        floor(o_totalprice / 10)::BIGINT AS n_chars
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    # beside the parts, entities that one document alone names
    "entities": f"""SELECT p_partkey AS id, p_name AS name, {_TYPE_SQL} AS type, lower(p_name) AS canonical FROM part
        UNION ALL SELECT 10000000 + o_orderkey, 'Lone ' || substr(md5(o_orderkey::VARCHAR), 1, 12), CASE o_orderkey % 2 WHEN 0 THEN 'person' ELSE 'org' END, 'lone ' || substr(md5(o_orderkey::VARCHAR), 1, 12) FROM orders WHERE o_orderkey % 97 = 0""",
    "mentions": """SELECT l_orderkey AS document_id, l_partkey AS entity_id, sum(l_quantity)::BIGINT AS count FROM lineitem GROUP BY 1, 2
        UNION ALL SELECT o_orderkey, 10000000 + o_orderkey, 12 FROM orders WHERE o_orderkey % 97 = 0""",
    "links": """SELECT a.entity_id AS entity_a_id, b.entity_id AS entity_b_id, count(DISTINCT a.document_id) AS weight
        FROM mentions a JOIN mentions b ON a.document_id = b.document_id AND a.entity_id < b.entity_id GROUP BY 1, 2""",
    "dated": """SELECT o_orderkey AS id, o_orderkey AS document_id,
        CASE o_orderkey % 10 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS event_date,
        CASE o_orderkey % 10 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'relative' ELSE 'day' END AS precision,
        ((o_orderkey * 7) % 100) / 100.0::DOUBLE AS confidence, o_orderkey % 10 <> 2 AS is_resolved, o_orderpriority || ' ' || o_orderstatus AS context FROM orders""",
    "event_entities": "SELECT DISTINCT l_orderkey AS event_id, l_partkey AS entity_id FROM lineitem WHERE l_linenumber <= 2",
    "indicators": """SELECT DISTINCT l_orderkey AS document_id, CASE l_returnflag WHEN 'A' THEN 'currency_amount' WHEN 'R' THEN 'account_number' ELSE 'swift_code' END AS indicator_type,
        floor(l_extendedprice)::BIGINT::VARCHAR AS value, floor(l_discount * 100 + 0.5)::BIGINT AS risk FROM lineitem WHERE l_extendedprice > 40000""",
    "resolutions": """SELECT id AS source_entity_id, target AS canonical_entity_id FROM
        (SELECT id, max(id) OVER (PARTITION BY canonical, type) AS target FROM entities) WHERE id <> target""",
    "aliases": "SELECT canonical_entity_id AS entity_id, name || ' #' || source_entity_id AS alias_name FROM resolutions JOIN entities ON id = source_entity_id",
    "facts": """SELECT id AS document_id, 'risk_score' AS analysis_type, 'overall' AS label, (id * 13) % 100 AS percent,
            CASE WHEN (id * 13) % 100 >= 70 THEN 'high' WHEN (id * 13) % 100 >= 40 THEN 'medium' ELSE 'low' END AS severity FROM docs
        UNION ALL SELECT id, 'topic', CASE id % 3 WHEN 0 THEN 'finance' WHEN 1 THEN 'travel' ELSE 'politics' END, (id * 29) % 100, 'info' FROM docs
        UNION ALL SELECT id, 'aml_flag', CASE id % 2 WHEN 0 THEN 'shell_company' ELSE 'structuring' END, (id * 31) % 100, CASE WHEN id % 3 = 0 THEN 'high' ELSE 'medium' END FROM docs WHERE id % 11 = 0
        UNION ALL SELECT id, 'codeword', 'word' || (id % 17), 50, 'medium' FROM docs WHERE id % 13 = 0
        UNION ALL SELECT id, 'tone', CASE id % 3 WHEN 0 THEN 'hostile' WHEN 1 THEN 'neutral' ELSE 'urgent' END, (id * 37) % 100, 'info' FROM docs WHERE id % 5 = 0""",
    "provenance": """SELECT o_orderkey AS document_id, CASE o_orderkey % 3 WHEN 0 THEN 'received' WHEN 1 THEN 'scanned' ELSE 'reviewed' END AS event_type, strftime(o_orderdate, '%Y-%m-%d') AS event_date,
        'step ' || (o_orderkey % 4) AS description, 'clerk ' || (o_custkey % 5) AS actor, strftime(o_orderdate + (o_orderkey % 5)::INT * INTERVAL 1 DAY, '%Y-%m-%d') AS created_at FROM orders WHERE o_orderkey % 8 = 0""",
    "ratings": "SELECT n_name AS source, CASE n_nationkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'D' END AS rating FROM nation WHERE n_nationkey % 2 = 0",
    "history": "SELECT event_type || ' ' || (user_id % 7) AS query, floor(value)::BIGINT AS results, strftime(ts, '%Y-%m-%d %H:%M:%S') AS searched_at FROM main.events WHERE event_id % 5 = 0",
    "tags": "SELECT id AS entity_id, CASE WHEN id % 10 = 0 THEN 'key' ELSE 'minor' END AS tag FROM entities WHERE id % 5 = 0 UNION ALL SELECT id, 'seen' FROM entities WHERE id % 15 = 0",
    "redactions": """SELECT id AS document_id, CASE id % 3 WHEN 0 THEN 'privacy' WHEN 1 THEN 'legal' ELSE 'security' END AS reason, (id % 50) * 3 AS start_offset, (id % 50) * 3 + (id % 240) + 1 AS end_offset
        FROM docs WHERE id % 6 = 0 UNION ALL SELECT id, 'legal', 5, 25 FROM docs WHERE id % 12 = 0""",
    "texts": "SELECT doc_id AS id, text, lang, source, length(text)::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL",
    "keywords": """SELECT id AS document_id, word, count(*) AS count FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM texts) GROUP BY 1, 2""",
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: Bindings that a binding is made of.
_NEEDS = {"links": ["mentions"], "resolutions": ["entities"], "aliases": ["resolutions", "entities"], "facts": ["docs"], "tags": ["entities"], "redactions": ["docs"], "keywords": ["texts"]}


from quaestor.plans.texts import SAMPLES  # noqa: E402

ORACLE["samples"] = " UNION ALL ".join(f"SELECT {k}::BIGINT AS id, {_text(n)} AS filename, {_text(t)} AS text" for k, (n, t) in enumerate(SAMPLES))
ORACLE["pages"] = "SELECT * FROM main.pages"
ORACLE["conversations"] = "SELECT * FROM main.conversations"
ORACLE["activity"] = "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, user_id, event_type, value FROM main.events"
ORACLE["pdf_metadata"] = """SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE c_mktsegment END AS author, CASE WHEN o_orderkey % 24 = 0 THEN '' ELSE o_orderpriority END AS creator,
    CASE WHEN o_orderkey % 24 = 0 THEN '' ELSE 'tool ' || o_orderkey % 5 END AS producer, strftime(o_orderdate, '%Y-%m-%d') AS creation_date,
    strftime(o_orderdate + (o_orderkey % 9 - 2)::INT * INTERVAL 1 DAY, '%Y-%m-%d') AS modification_date, o_orderkey % 8 = 0 AS encrypted FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 = 0 AND o_orderkey % 20 <> 0"""


#: Tables and columns of a corpus.
COLUMNS = {
    "docs": "id long, filename string, title string, category string, source string, date string, pages long, file_hash string, flagged boolean, ingest_day string, ingest_hour long, notes string, n_chars long",
    "texts": "id long, text string, lang string, source string, n_chars long",
    "entities": "id long, name string, type string, canonical string",
    "mentions": "document_id long, entity_id long, count long",
    "links": "entity_a_id long, entity_b_id long, weight long",
    "dated": "id long, document_id long, event_date string, precision string, confidence double, is_resolved boolean, context string",
    "event_entities": "event_id long, entity_id long",
    "indicators": "document_id long, indicator_type string, value string, risk long",
    "resolutions": "source_entity_id long, canonical_entity_id long",
    "aliases": "entity_id long, alias_name string",
    "facts": "document_id long, analysis_type string, label string, percent long, severity string",
    "tags": "entity_id long, tag string",
    "redactions": "document_id long, reason string, start_offset long, end_offset long",
    "keywords": "document_id long, word string, count long",
    "provenance": "document_id long, event_type string, event_date string, description string, actor string, created_at string",
    "ratings": "source string, rating string",
    "history": "query string, results long, searched_at string",
    "pdf_metadata": "document_id long, author string, creator string, producer string, creation_date string, modification_date string, encrypted boolean",
}


class Corpus:
    """The tables that routes and plans read: bindings over one directory of tables, built when first asked for, or given ones (``of``)."""

    def __init__(self, spark: SparkSession, sf_dir: str | None):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        self.kept: dict = {}  # what a route writes once for all later calls
        self.index = None  # a ``functions.fulltext.Fulltext`` over the documents, where one is kept

    @classmethod
    def of(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> Corpus:
        """A corpus of given tables, with the columns of ``COLUMNS``; those not given are empty, but ``keywords``, ``links``,
        ``resolutions`` and ``aliases`` are made of ``texts``, ``mentions`` and ``entities`` where these are given."""
        if unknown := tables.keys() - COLUMNS.keys():
            raise ValueError(f"no tables {sorted(unknown)}: {', '.join(COLUMNS)}")
        corpus = cls(spark, None)
        sources = {"keywords": "texts", "links": "mentions", "resolutions": "entities", "aliases": "entities"}
        for name, schema in COLUMNS.items():
            if name in tables:
                corpus._made[name] = tables[name].select(*(F.col(c).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in schema.split(", "))))
            elif sources.get(name) not in tables:
                corpus._made[name] = spark.createDataFrame([], schema)
        return corpus

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = getattr(self, f"_{name}")()
        return self._made[name]

    def sql(self, plan: str) -> DataFrame:
        for name in set(re.findall(r"\{(\w+)\}", plan)) & ORACLE.keys():
            self[name].createOrReplaceTempView(f"quaestor_{name}")
        words = _dialect(plan, "spark", lambda n: f"quaestor_{n}")
        for name in set(re.findall(r"quaestor_(?:hits|present)_[0-9a-f]{8}", words)):
            self.spark.udf.register(name, matcher.counter(*matcher.COUNTERS[name]))
        return self.spark.sql(words)

    def tasks(self, rows: int = 250_000) -> int:
        """Tasks of about so many mentions each; of standard tables the lines are counted, which reads no column."""
        held = self.raw("lineitem") if self.sf_dir else self["mentions"]
        return max(1, -(-held.count() // rows))

    def dealt(self, **keys: str) -> Corpus:
        """The corpus with some tables dealt by a column each to ``tasks``, so that what a task holds stays as it is on larger tables."""
        n = self.tasks()
        for name, key in keys.items():
            self._made[name] = self[name].repartition(n, key)
        return self

    def _orders(self) -> DataFrame:
        return self.raw("orders").join(self.raw("customer"), F.expr("o_custkey = c_custkey")).join(self.raw("nation"), F.expr("c_nationkey = n_nationkey"))

    def _category(self) -> Column:
        return functools.reduce(lambda c, kv: c.when(F.col("o_orderpriority") == kv[0], kv[1]), list(CATEGORIES.items())[1:], F.when(F.col("o_orderpriority") == "1-URGENT", "deposition")).otherwise("other")

    def headed(self) -> DataFrame:
        """(id, title, category, source) of ``docs`` of standard tables, whose lines are not counted for that."""
        category = self._category()
        return self._orders().select(F.col("o_orderkey").alias("id"), F.concat(category, F.lit(" of "), "c_name").alias("title"), category.alias("category"), F.col("n_name").alias("source"))

    def _docs(self) -> DataFrame:
        lines = self.raw("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
        category = self._category()
        extension = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
        pages = F.coalesce("lines", F.lit(0)).cast("long")
        return self._orders().join(lines, F.expr("l_orderkey = o_orderkey"), "left").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("order_"), "o_orderkey", F.lit("."), extension).alias("filename"), F.concat(category, F.lit(" of "), "c_name").alias("title"),
            category.alias("category"), F.col("n_name").alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), pages.alias("pages"),
            F.concat(F.lit("h"), F.col("o_custkey") * 16 + pages).alias("file_hash"), (F.col("o_orderstatus") == "F").alias("flagged"),
            F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5).cast("int")), "yyyy-MM-dd").alias("ingest_day"), (F.col("o_orderkey") % 24).alias("ingest_hour"),
            F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("checked [tag:"), F.lower("c_mktsegment"), F.lit("]"))).otherwise("").alias("notes"), F.floor(F.col("o_totalprice") / 10).alias("n_chars"),
        )

    def _entities(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("p_partkey") % 4 + 1).cast("int"))
        parts = self.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("type"), F.lower("p_name").alias("canonical"))
        lone = self.raw("orders").filter("o_orderkey % 97 = 0").selectExpr("10000000 + o_orderkey AS id", "concat('Lone ', substr(md5(string(o_orderkey)), 1, 12)) AS name", "IF(o_orderkey % 2 = 0, 'person', 'org') AS type", "concat('lone ', substr(md5(string(o_orderkey)), 1, 12)) AS canonical")
        return parts.unionAll(lone)

    def _mentions(self) -> DataFrame:
        lines = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("entity_id")).agg(F.sum("l_quantity").cast("long").alias("count"))
        return lines.unionAll(self.raw("orders").filter("o_orderkey % 97 = 0").selectExpr("o_orderkey", "10000000 + o_orderkey", "12L"))

    def _links(self) -> DataFrame:
        from quaestor.operators.pairs import co_occurrence

        return co_occurrence(self["mentions"], "document_id", "entity_id").toDF("entity_a_id", "entity_b_id", "weight")

    def _dated(self) -> DataFrame:
        last = F.col("o_orderkey") % 10
        form = lambda f: F.date_format("o_orderdate", f)
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("document_id"),
            F.when(last == 0, form("yyyy")).when(last == 1, form("yyyy-MM")).when(last != 2, form("yyyy-MM-dd")).alias("event_date"),
            F.when(last == 0, "year").when(last == 1, "month").when(last == 2, "relative").otherwise("day").alias("precision"),
            ((F.col("o_orderkey") * 7 % 100) / 100.0).alias("confidence"), (last != 2).alias("is_resolved"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("context"),
        )

    def _event_entities(self) -> DataFrame:
        return self.raw("lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id")).distinct()

    def _indicators(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "A", "currency_amount").when(F.col("l_returnflag") == "R", "account_number").otherwise("swift_code")
        rows = self.raw("lineitem").filter("l_extendedprice > 40000")
        return rows.select(F.col("l_orderkey").alias("document_id"), kind.alias("indicator_type"), F.floor("l_extendedprice").cast("string").alias("value"), F.floor(F.col("l_discount") * 100 + 0.5).alias("risk")).distinct()

    def _resolutions(self) -> DataFrame:
        best = self["entities"].groupBy("canonical", "type").agg(F.max("id").alias("target"))
        return self["entities"].join(best, ["canonical", "type"]).filter("id <> target").select(F.col("id").alias("source_entity_id"), F.col("target").alias("canonical_entity_id"))

    def _aliases(self) -> DataFrame:
        found = self["resolutions"].join(self["entities"], F.expr("id = source_entity_id"))
        return found.select(F.col("canonical_entity_id").alias("entity_id"), F.concat("name", F.lit(" #"), "source_entity_id").alias("alias_name"))

    def _facts(self) -> DataFrame:
        d = self["docs"]
        risk = (F.col("id") * 13) % 100
        fact = lambda rows, kind, label, percent, severity: rows.select(F.col("id").alias("document_id"), F.lit(kind).alias("analysis_type"), label.alias("label"), percent.alias("percent"), severity.alias("severity"))
        parts = [
            fact(d, "risk_score", F.lit("overall"), risk, F.when(risk >= 70, "high").when(risk >= 40, "medium").otherwise("low")),
            fact(d, "topic", F.element_at(F.array(*map(F.lit, ("finance", "travel", "politics"))), (F.col("id") % 3 + 1).cast("int")), (F.col("id") * 29) % 100, F.lit("info")),
            fact(d.filter("id % 11 = 0"), "aml_flag", F.expr("IF(id % 2 = 0, 'shell_company', 'structuring')"), (F.col("id") * 31) % 100, F.expr("IF(id % 3 = 0, 'high', 'medium')")),
            fact(d.filter("id % 5 = 0"), "tone", F.element_at(F.array(*map(F.lit, ("hostile", "neutral", "urgent"))), (F.col("id") % 3 + 1).cast("int")), (F.col("id") * 37) % 100, F.lit("info")),
            fact(d.filter("id % 13 = 0"), "codeword", F.concat(F.lit("word"), F.col("id") % 17), F.lit(50).cast("long"), F.lit("medium")),
        ]
        return functools.reduce(DataFrame.unionAll, parts)

    def _tags(self) -> DataFrame:
        e = self["entities"]
        return e.filter("id % 5 = 0").selectExpr("id AS entity_id", "IF(id % 10 = 0, 'key', 'minor') AS tag").unionAll(e.filter("id % 15 = 0").selectExpr("id", "'seen'"))

    def _redactions(self) -> DataFrame:
        d = self["docs"]
        spans = d.filter("id % 6 = 0").selectExpr("id AS document_id", "CASE id % 3 WHEN 0 THEN 'privacy' WHEN 1 THEN 'legal' ELSE 'security' END AS reason", "(id % 50) * 3 AS start_offset", "(id % 50) * 3 + (id % 240) + 1 AS end_offset")
        return spans.unionAll(d.filter("id % 12 = 0").selectExpr("id", "'legal'", "5L", "25L"))

    def _texts(self) -> DataFrame:
        return self.raw("documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))

    def _samples(self) -> DataFrame:
        return self.spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(SAMPLES)], "id long, filename string, text string")

    def _pages(self) -> DataFrame:
        return self.raw("pages")

    def _conversations(self) -> DataFrame:
        return self.raw("conversations")

    def _provenance(self) -> DataFrame:
        rows = self.raw("orders").filter("o_orderkey % 8 = 0")
        return rows.selectExpr(
            "o_orderkey AS document_id", "CASE o_orderkey % 3 WHEN 0 THEN 'received' WHEN 1 THEN 'scanned' ELSE 'reviewed' END AS event_type", "date_format(o_orderdate, 'yyyy-MM-dd') AS event_date",
            "concat('step ', o_orderkey % 4) AS description", "concat('clerk ', o_custkey % 5) AS actor", "date_format(date_add(to_date(o_orderdate), CAST(o_orderkey % 5 AS INT)), 'yyyy-MM-dd') AS created_at",
        )

    def _ratings(self) -> DataFrame:
        return self.raw("nation").filter("n_nationkey % 2 = 0").selectExpr("n_name AS source", "CASE n_nationkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'D' END AS rating")

    def _history(self) -> DataFrame:
        rows = self.raw("events").filter("event_id % 5 = 0")
        return rows.select(F.concat("event_type", F.lit(" "), F.col("user_id") % 7).alias("query"), F.floor("value").alias("results"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("searched_at"))

    def _activity(self) -> DataFrame:
        return self.raw("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", "event_type", "value")

    def _pdf_metadata(self) -> DataFrame:
        k = F.col("o_orderkey")
        o = self.raw("orders").filter((k % 4 == 0) & (k % 20 != 0)).join(self.raw("customer"), F.expr("o_custkey = c_custkey"))
        changed = F.date_add(F.to_date("o_orderdate"), (k % 9 - 2).cast("int"))
        return o.select(
            k.alias("document_id"), F.when(k % 12 == 0, "").otherwise(F.col("c_mktsegment")).alias("author"), F.when(k % 24 == 0, "").otherwise(F.col("o_orderpriority")).alias("creator"),
            F.when(k % 24 == 0, "").otherwise(F.concat(F.lit("tool "), k % 5)).alias("producer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("creation_date"),
            F.date_format(changed, "yyyy-MM-dd").alias("modification_date"), (k % 8 == 0).alias("encrypted"),
        )

    def _keywords(self) -> DataFrame:
        words = self["texts"].select(F.col("id").alias("document_id"), F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]{3,}', 0)")).alias("word"))
        return words.groupBy("document_id", "word").agg(F.count("*").alias("count"))


def _call(plan: str, name: str, start: int) -> tuple[int, int, int] | None:
    """(start, first character inside, closing bracket) of the next call of a function."""
    m = re.compile(rf"\b{name}\(").search(plan, start)
    if not m:
        return None
    depth, quote = 1, False
    for k in range(m.end(), len(plan)):
        c = plan[k]
        if c == "'":
            quote = not quote
        elif not quote:
            depth += (c == "(") - (c == ")")
            if depth == 0:
                return m.start(), m.end(), k
    raise ValueError(f"{name} is not closed")


def _arguments(text: str) -> list[str]:
    """Arguments of a call, parted at its own commas."""
    out, depth, quote, start = [], 0, False, 0
    for k, c in enumerate(text):
        if c == "'":
            quote = not quote
        elif not quote:
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 0:
                out.append(text[start:k].strip())
                start = k + 1
    return [*out, text[start:].strip()]


def _regex(literal: str) -> str:
    """A quoted pattern as Spark reads it: a raw string."""
    return literal if literal.startswith("r'") else "r" + literal


def _counter(present: bool):
    return lambda x, *words: f"{matcher.counter_name([text.unquoted(w) for w in words], present)}({x})"


_SPARK = {
    "HITS": _counter(False),
    "PRESENT": _counter(True),
    "JOINED": lambda x: f"array_join(array_sort(collect_set({x})), ',')",
    "DAYS": lambda a, b: f"CAST(datediff(CAST({b} AS DATE), CAST({a} AS DATE)) AS BIGINT)",
    "WEEKDAY": lambda d: f"CAST(dayofweek(CAST({d} AS DATE)) - 1 AS BIGINT)",
    "MATCHES": lambda x, r: f"({x} RLIKE {_regex(r)})",
    "ALLMATCHES": lambda x, r, g: f"regexp_extract_all({x}, {_regex(r)}, {g})",
    "COUNTED": lambda x, r: f"CAST(size(filter({x}, a -> a RLIKE {_regex(r)})) AS BIGINT)",
    "DISTINCTS": lambda x: f"array_distinct({x})",
    "LABELLED": lambda label, n: f"named_struct('label', {label}, 'hits', {n})",
    "ARRAY_OF": lambda *xs: f"array({', '.join(xs)})",
    "UNNESTED": lambda x: f"explode({x})",
    "SHINGLES": lambda x, n: f"CASE WHEN size({x}) >= {n} THEN transform(sequence(1, size({x}) - {n} + 1), k -> array_join(slice({x}, k, {n}), ' ')) END",
    "WORDS": lambda x: f"greatest(CAST(size(filter(split({x}, r'[ \t\n\r]+'), w -> w != '')) AS BIGINT), 1L)",
    "regexp_replace": lambda x, r, y, *flags: f"regexp_replace({x}, {_regex(r)}, {y})",
}
_DUCKDB = {
    "HITS": text.each_hit,
    "PRESENT": text.each_present,
    "JOINED": lambda x: f"string_agg(DISTINCT {x}, ',' ORDER BY {x})",
    "DAYS": lambda a, b: f"date_diff('day', CAST({a} AS DATE), CAST({b} AS DATE))",
    "WEEKDAY": lambda d: f"CAST(dayofweek(CAST({d} AS DATE)) AS BIGINT)",
    "MATCHES": lambda x, r: f"regexp_matches({x}, {r})",
    "ALLMATCHES": lambda x, r, g: f"regexp_extract_all({x}, {r}, {g})",
    "COUNTED": lambda x, r: f"CAST(len(list_filter({x}, lambda a: regexp_matches(a, {r}))) AS BIGINT)",
    "DISTINCTS": lambda x: f"list_distinct({x})",
    "LABELLED": lambda label, n: f"struct_pack(label := {label}, hits := {n})",
    "ARRAY_OF": lambda *xs: f"[{', '.join(xs)}]",
    "UNNESTED": lambda x: f"unnest({x})",
    "SHINGLES": lambda x, n: f"list_transform(range(1, len({x}) - {n} + 2), lambda k: array_to_string(({x})[k:k + {n} - 1], ' '))",
    "WORDS": lambda x: f"greatest(len(list_filter(regexp_split_to_array({x}, '[ \t\n\r]+'), lambda w: w <> ''))::BIGINT, 1)",
}


def _dialect(plan: str, engine: str, view) -> str:
    """A plan in an engine's words: ``{name}`` bindings, and the few functions that the engines spell differently."""
    plan = re.sub(r"\{(\w+)\}", lambda m: view(m[1]) if m[1] in ORACLE else m[0], plan)
    for name, spell in (_SPARK if engine == "spark" else _DUCKDB).items():
        start = 0
        while at := _call(plan, name, start):
            text = spell(*_arguments(plan[at[1] : at[2]]))
            plan = plan[: at[0]] + text + plan[at[2] + 1 :]
            start = at[0] + (len(name) + 1 if name in text else 0)
    return plan


def oracle(plan: str) -> str:
    """The plan as one statement over the standard tables."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in re.findall(r"\{(\w+)\}", plan):
        if name in ORACLE:
            need(name)
    body = _dialect(plan, "duckdb", lambda n: n).strip()
    tables = ", ".join(f"{n} AS ({ORACLE[n]})" for n in wanted)
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {tables}, {body[14:]}" if tables else body
    if body[:4].upper() == "WITH":
        return f"WITH {tables}, {body[4:]}" if tables else body
    return f"WITH {tables} {body}" if tables else body
