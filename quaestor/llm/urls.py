"""URL filters: fixed rules first, then association rules that FP-growth mines from labelled pages.

Everything runs as DataFrame and SQL functions (and Spark's own FP-growth).

Fixed rules are (host, path, verdict): a rule fits its host and all subdomains of it where the
path starts with the rule's; of those that fit the longest wins.  Each url looks its rules up
by equality with the suffixes of its host, so their number costs nothing per url.

Elsewhere the url's tokens decide: host labels and suffixes, path segments with digits folded,
query keys.  Labels are those of the document of the page's number; a page is bad where its
quality is 0 or it is toxic.  A rule is a combination of tokens that at least ``least_rows``
bad labelled pages hold, of all labelled pages that hold it at least the share ``confidence``
bad, and of which no part is a rule already.  A url that holds all tokens of a rule is blocked.

Mining is exact and stays small where tokens of one url repeat each other, as the segments of a
deep path do.  Tokens that occur in the same labelled pages are interchangeable: they are one
item, of which a url needs any one token.  Items that are rules alone, or that too few bad pages
hold, leave the baskets.  Spark's FP-growth then finds the combinations in the bad pages alone;
those that clean pages hold too often, and those with a smaller rule inside, are dropped.  The
support is a number of pages, so rules of rare hosts stay as the labels grow.

Rules are filed under their rarest item (an inverted index): a url meets only the rules of items
it has.

Empty cases: a null url, or one without ``://``, has an empty host and path, fits no rule and
has no tokens, so it is allowed.  Pages that share an id are judged one by one, and each counts
where it is labelled; several labels of one number are bad if one is.  Null labels are no bad
labels.  Without labelled pages nothing is mined.  Empty tables
give an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

def _lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(pages: DataFrame, page_id: str, url: str) -> DataFrame:
    """(page_id, url, host, path)"""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url")).withColumn("rest", F.coalesce(rest, F.lit("")))
    host = _lower(F.regexp_extract("rest", r"^[^/?#]*", 0))
    return rows.select("page_id", "url", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def _suffixes(host: str) -> str:
    labels = f"split({host}, '[.]')"
    return f"transform(sequence(1, size({labels})), k -> array_join(slice({labels}, k, size({labels})), '.'))"


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``urls`` (page_id, url, host, path) with rule and the rule's verdict, both null where none fits."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    entries = ", ".join(f"named_struct('host', {_quoted(h)}, 'rules', array({', '.join(f'named_struct({chr(39)}path{chr(39)}, {_quoted(p)}, {chr(39)}verdict{chr(39)}, {_quoted(v)})' for p, v in r)}))" for h, r in by_host.items())
    if not entries:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("ruled", F.lit(None).cast("string"))
    index = f"map_from_entries(transform(array({entries}), x -> struct(x.host, x.rules)))"
    fits = f"flatten(transform(filter({_suffixes('host')}, h -> map_contains_key({index}, h)), h -> transform(filter({index}[h], r -> startswith(path, r.path)), r -> struct(length(h) + length(r.path) AS n, concat(h, r.path) AS rule, r.verdict AS verdict))))"
    best = urls.withColumn("best", F.array_max(F.expr(fits)))
    return best.select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens(url: str = "url", host: str = "host", path: str = "path") -> Column:
    """Distinct tokens of a url, as an expression over those columns."""
    return F.expr(
        f"""CASE WHEN {host} = '' THEN cast(array() AS array<string>) ELSE array_distinct(concat(
            transform(split({host}, '[.]'), x -> concat('label=', x)),
            transform(filter({_suffixes(host)}, x -> instr(x, '.') > 0), x -> concat('host=', x)),
            transform(filter(split({path}, '/'), x -> x != ''), x -> concat('segment=', regexp_replace(x, '[0-9]+', '0'))),
            transform(regexp_extract_all({url}, '[?&]([^=&#]+)', 1), x -> concat('key=', x)))) END"""
    )


def _with_items(baskets: DataFrame, items: DataFrame, *kept: str) -> DataFrame:
    """``baskets`` (key, tokens and ``kept``) that hold an item, with all items they hold."""
    held = baskets.select("key", *kept, F.explode("tokens").alias("token")).join(items.select("token", "item"), "token")
    return held.groupBy("key", *kept).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _anchored(sets: DataFrame, items: DataFrame) -> DataFrame:
    """``sets`` (items, ...) with their rarest item as ``anchor``."""
    counts = items.select("item", "n").distinct()
    rarest = sets.select("items", F.explode("items").alias("item")).join(counts, "item").groupBy("items").agg(F.min(F.struct("n", "item")).alias("m"))
    return sets.join(rarest.select("items", F.col("m.item").alias("anchor")), "items")


def mined_rules(urls: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic", least_rows: int = 25, confidence: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rules (items, anchor, confidence) and the tokens of their items (token, item): written tables."""
    from pyspark.ml.fpm import FPGrowth

    spark = urls.sparkSession
    bad = F.coalesce((F.col(quality) == 0) | (F.col(toxic) == 1), F.lit(False))
    judged = labels.select(F.col(doc_id).cast("long").alias("page_id"), bad.alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))
    # equal urls weigh their number
    baskets = urls.join(judged, "page_id").groupBy("url", "host", "path").agg(F.expr("count_if(bad)").alias("bad"), F.expr("count_if(NOT bad)").alias("clean"))
    baskets = written(baskets.select(F.col("url").alias("key"), tokens().alias("tokens"), "bad", "clean").filter("size(tokens) > 0"), "baskets")

    held = baskets.select("key", "bad", "clean", F.explode("tokens").alias("token"))
    where = [F.expr(f"bit_xor(xxhash64(key, {k}))").alias(f"at{k}") for k in (1, 2)]  # the set of pages, as 128 bits
    counted = held.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("clean")).alias("n"), *where).filter(F.col("bad") >= least_rows)
    same = counted.groupBy("bad", "n", "at1", "at2").agg(F.min("token").alias("item"), F.collect_list("token").alias("token"))
    items = written(same.select("item", F.explode("token").alias("token"), "bad", "n"), "items")

    sure = F.col("bad") >= confidence * F.col("n")
    alone = items.filter(sure).select("item", "bad", "n").distinct().select(F.array("item").alias("items"), F.col("item").alias("anchor"), (F.col("bad") / F.col("n")).alias("confidence"))
    open_items = items.filter(~sure)
    mixed = written(_with_items(baskets, open_items, "bad", "clean").filter("size(items) > 1"), "mixed")
    pages = mixed.filter("bad > 0").select("items", F.explode(F.sequence(F.lit(1), F.col("bad").cast("int")))).select("items")
    many = pages.count()
    if many >= least_rows:
        model = FPGrowth(itemsCol="items", minSupport=(least_rows - 0.5) / many).fit(pages)
        sets = model.freqItemsets.filter("size(items) > 1").select(F.array_sort("items").alias("items"), F.col("freq").alias("bad"))
        sets = written(_anchored(sets, open_items), "sets")
        clean = mixed.filter("clean > 0").select("clean", F.col("items").alias("all"), F.explode("items").alias("anchor"))
        clean = clean.join(sets, "anchor").filter("size(array_except(items, all)) = 0").groupBy("items").agg(F.sum("clean").alias("clean"))
        share = F.col("bad") / (F.col("bad") + F.coalesce("clean", F.lit(0)))
        found = written(sets.join(clean, "items", "left").select("items", "anchor", share.alias("confidence")).filter(F.col("confidence") >= confidence), "combined")
        inside = found.select(F.col("items").alias("part"), F.col("anchor").alias("item"))
        wider = found.select("items", F.explode("items").alias("item")).join(inside, "item").filter("size(part) < size(items) AND size(array_except(part, items)) = 0")
        alone = alone.unionByName(found.join(wider.select("items").distinct(), "items", "left_anti").select("items", "anchor", "confidence"))
    rules = written(alone, "rules")
    used = rules.select(F.explode("items").alias("item")).distinct()
    return rules, written(items.join(used, "item").select("token", "item"), "tokens")


def judged(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], *, page_id: str = "page_id", url: str = "url", broadcast_rules: int = 10_000, **options,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the confidence of the mined rule that blocked it (null: none)."""
    urls = parts(pages, page_id, url)
    index, items = mined_rules(urls, labels, **options)
    few = lambda table: F.broadcast(table) if table.count() <= broadcast_rules else table
    # equal urls are judged once, and a popular url's or host's rows stay where they are
    distinct = ruled(urls.select("url", "host", "path").distinct(), rules).filter("rule IS NULL").select(F.col("url").alias("key"), tokens().alias("tokens"))
    hits = _with_items(distinct, few(items)).select(F.col("key").alias("url"), F.col("items").alias("all"), F.explode("items").alias("anchor")).join(few(index), "anchor")
    blocked = hits.filter("size(array_except(items, all)) = 0").groupBy("url").agg(F.max("confidence").alias("confidence"))
    verdict = F.coalesce("ruled", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return ruled(urls, rules).join(blocked, "url", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))
