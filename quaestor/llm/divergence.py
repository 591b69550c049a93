"""How far sources of one language differ in their words, exactly, by a heavy-light split.

Documents are counted in tasks by language and source; only sums are shuffled.  A term's share p
in a group is an integer (see ``shares``).  The distance of two groups is the sum of |p - q| over
all kept terms.  A group has one share, p0, for every term that it lacks, so with V terms

    distance(g, h) = V |p0(g) - p0(h)| + corrections for the terms that g or h holds.

Terms in more than one of ``rare`` groups of their language are heavy: tiles of at most ``side``
groups by ``side`` groups by a part of the terms are dense arrays, and a tile adds
|p - q| - |p0(g) - p0(h)| over its terms.  The others are light.  A light term that one of the two
groups holds adds |p(g) - p0(h)| - |p0(g) - p0(h)|, whichever term it is: that needs a group's
counts of equal shares alone.  Where both hold it, its postings' pair puts this right by
|p - q| - |p(g) - p0(h)| - |p0(g) - p(h)| + |p0(g) - p0(h)|.  All sums are of 64-bit integers.

Null text, language and source are ''.  Groups without terms count, with p0 for every kept term;
where a language keeps no term all distances are 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settled, small_batches, written
from .words import release, slices

_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or k in _LETTERS else 32 for k in range(256))


def _counts(docs: DataFrame, text: str, lang: str, source: str, most: int = 400_000) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a group's row without a term gives its presence."""
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), empty).alias("lang"), F.coalesce(F.col(source).cast("string"), empty).alias("source"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        held: dict[tuple, Counter] = defaultdict(Counter)
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                terms = [None, *own]
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array([0, *own.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([0, *map(held[lang, source].__getitem__, own)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            n.clear()
            held.clear()

        for batch in batches:
            for part in slices(batch, "body"):
                for lang, source, body in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "body")), strict=True):
                    words = body.translate(_TABLE).split(b" ")
                    own = Counter(words)
                    del own[b""]
                    total = n[lang, source]
                    before = len(total)
                    total.update(own)
                    held[lang, source].update(own.keys())
                    size += len(total) - before + 1
                    if size > most:
                        yield from flushed()
                        size = 0
        yield from flushed()
        release()

    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def shares(docs: DataFrame, *, least_docs: int = 30, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: (groups, langs, cells).

    groups: lang, source, p0.  langs: lang, v (kept terms).  cells: lang, source, term, p, q (the lang's share), spread (groups
    that hold the term), for every kept term that occurs in the group.  Shares are 1 + floor(10**9 (count + 5) / (N + 5 V)).
    """
    small_batches(docs.sparkSession)
    counts = written(_counts(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    terms = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("spread"))
    kept = written(terms.filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    cells = written(counts.drop("docs").join(kept, ["lang", "term"]), "cells")
    langs = counts.filter("term IS NULL").select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_all")), "lang", "left").na.fill(0, ["v", "lang_all"])
    langs = written(langs, "langs")
    share = lambda n, all_n: f"1 + cast((cast(1000000000 AS decimal(10,0)) * cast({n} + 5 AS decimal(20,0))) div cast(greatest({all_n} + 5 * v, 1) AS decimal(20,0)) AS long)"
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_all"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["group_all"]).join(langs, "lang")
    groups = written(groups.withColumn("p0", F.expr(share("0", "group_all"))), "groups")
    cells = cells.join(groups.drop("p0"), ["lang", "source"]).select("lang", "source", "term", F.expr(share("n", "group_all")).alias("p"), F.expr(share("lang_n", "lang_all")).alias("q"), "spread")
    return groups.select("lang", "source", "p0"), langs.select("lang", "v"), written(cells, "shares")


def _tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Corrections of the pairs of one tile: dense terms, and light terms that one of the two holds."""
    lang, first, second, _ = key
    own = rows[rows["kind"] == 0].sort_values("source")
    names, p0 = own["source"].to_numpy(), own["p0"].to_numpy(np.int64)
    place = {s: k for k, s in enumerate(names)}
    side = own["side"].to_numpy()
    total = np.zeros((len(names), len(names)), np.int64)
    dense = rows[rows["kind"] == 1]
    if len(dense):
        at, terms = pd.factorize(dense["term"])
        tile = np.repeat(p0[:, None], len(terms), axis=1)
        tile[dense["source"].map(place).to_numpy(), at] = dense["p"].to_numpy(np.int64)
        for k in range(len(names)):
            total[k] += np.abs(tile[k] - tile).sum(axis=1) - len(terms) * np.abs(p0[k] - p0)
    for source, light in rows[rows["kind"] == 2].groupby("source"):
        k = place[source]
        p, m = light["p"].to_numpy(np.int64), light["m"].to_numpy(np.int64)
        order = np.argsort(p)
        p, m = p[order], m[order]
        number, weight = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(p * m)])
        below = np.searchsorted(p, p0)
        distance = p0 * number[below] - weight[below] + (weight[-1] - weight[below]) - p0 * (number[-1] - number[below])
        one = distance - number[-1] * np.abs(p0[k] - p0)
        total[k] += one
        total[:, k] += one
    a, b = np.triu_indices(len(names), 1)
    wanted = (side[a] != side[b]) if first != second else np.ones(len(a), bool)
    a, b = a[wanted], b[wanted]
    return pd.DataFrame({"lang": lang, "s1": names[a], "s2": names[b], "value": total[a, b]})


def pair_distances(groups: DataFrame, langs: DataFrame, cells: DataFrame, *, rare: float = 0.125, side: int = 256, terms: int = 4096) -> DataFrame:
    """lang, s1 < s2, value for every two groups of a lang."""
    sizes = written(groups.groupBy("lang").agg(F.count("*").alias("g")), "group-sizes")
    pieces = max(1, -(-(sizes.agg(F.max("g")).first()[0] or 0) // side))
    part = F.pmod(F.xxhash64("source"), F.lit(pieces)).cast("int")
    split = cells.join(sizes, "lang")
    heavy = F.col("spread") > F.greatest(F.lit(1), F.col("g") * F.lit(rare))
    chunks = max(1, -(-cells.select("lang", "term", "spread").join(sizes, "lang").filter(heavy).agg(F.count_distinct("lang", "term")).first()[0] // terms))
    nothing = F.lit(None).cast("long")
    dense = split.filter(heavy).select("lang", "source", F.lit(1).alias("kind"), part.alias("part"), F.pmod(F.xxhash64("term"), F.lit(chunks)).alias("chunk"), "term", "p", nothing.alias("m"), nothing.alias("p0"))
    light = split.filter(~heavy)
    equal = light.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    equal = equal.select("lang", "source", F.lit(2).alias("kind"), part.alias("part"), F.pmod(F.xxhash64("p"), F.lit(chunks)).alias("chunk"), F.lit(None).cast("binary").alias("term"), "p", "m", nothing.alias("p0"))
    own = groups.select("lang", "source", F.lit(0).alias("kind"), part.alias("part"), F.explode(F.expr(f"sequence(0L, {chunks - 1}L)")).alias("chunk"), F.lit(None).cast("binary").alias("term"), nothing.alias("p"), nothing.alias("m"), "p0")
    rows = own.unionByName(dense).unionByName(equal)
    other = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    tiles = rows.withColumn("other", other).select("*", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), F.col("part").alias("side"))
    corrections = tiles.drop("part", "other").groupBy("lang", "first", "second", "chunk").applyInPandas(_tile, "lang string, s1 string, s2 string, value long")
    posting = light.join(groups, ["lang", "source"]).select("lang", "term", "source", "p", "p0")
    a = posting.select("lang", "term", F.col("source").alias("s1"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    b = posting.select("lang", "term", F.col("source").alias("s2"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    both = a.join(b, ["lang", "term"]).filter("s1 < s2").groupBy("lang", "s1", "s2").agg(F.sum(F.expr("abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb)")).alias("value"))
    summed = corrections.unionByName(both).groupBy("lang", "s1", "s2").agg(F.sum("value").alias("value"))
    ends = groups.select("lang", F.col("source").alias("s1"), F.col("p0").alias("z1")), groups.select("lang", F.col("source").alias("s2"), F.col("p0").alias("z2"))
    return (
        summed.join(ends[0], ["lang", "s1"]).join(ends[1], ["lang", "s2"]).join(langs, "lang")
        .select("lang", "s1", "s2", F.expr("CASE WHEN v = 0 THEN 0L ELSE v * abs(z1 - z2) + value END").alias("value"))
    )


def divergences(docs: DataFrame, *, least_docs: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """lang, source, part (``pair``: every other source of the lang; ``term``: the ``top`` terms used more than in the lang), item, value, rank."""

    def build() -> DataFrame:
        groups, langs, cells = shares(docs, least_docs=least_docs, text=text, lang=lang, source=source)
        pairs = pair_distances(groups, langs, cells, **options)
        ways = F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item"))))
        pair = pairs.select("lang", ways.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
        over = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        pair = pair.withColumn("rank", F.row_number().over(over))
        term = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        return pair.unionByName(term.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= top))

    return settled(docs.sparkSession, "divergences", build)
