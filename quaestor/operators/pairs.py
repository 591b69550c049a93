"""Joins and windows that many plans share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def co_occurrence(bridge: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b, weight): members a < b of a bridge table and the number of groups that hold both.

    Groups of one member are dropped before the self-join.  Each pair travels as one row of a
    group, and partial counts are combined before the shuffle.
    """
    rows = bridge.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    left, right = rows.select("g", F.col("m").alias("a")), rows.select("g", F.col("m").alias("b"))
    return left.join(right, "g").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


#: Groups of a member up to which its set travels with each of its keys; larger ones are looked up for their candidates.
CARRIED = 4096


def _rarest_first(bridge: DataFrame, member: str, group: str) -> DataFrame:
    """(m, n, items, c): a member's distinct groups, those of fewest members first, and the smallest member with the same groups, its class."""
    rows = bridge.select(F.col(member).alias("m"), F.col(group).alias("g")).filter("m IS NOT NULL AND g IS NOT NULL").distinct()
    sizes = rows.groupBy("g").agg(F.count("*").alias("f"))
    items = rows.join(sizes, "g").groupBy("m").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("s"))
    sets = items.select("m", F.size("s").alias("n"), F.transform("s", lambda x: x["g"]).alias("items"))
    return sets.withColumn("c", F.min("m").over(Window.partitionBy("items")))


def _counted(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared) of candidate pairs, once each."""
    both = candidates.distinct().join(sets.toDF("a", "n_a", "items_a"), "a").join(sets.toDF("b", "n_b", "items_b"), "b")
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("shared"))


def _meeting(sets: DataFrame, near: str, far: str, turn: str, enough: str, carried: int) -> DataFrame:
    """(a, b, shared), a < b, of members that meet and have ``enough`` in common.

    Sets of equal groups are one class, which looks for others once and is written out at the end.  A class is filed under its
    first groups (``near`` for a, ``far`` for b) together with its set, so that a pair is settled where it meets: it counts
    under the first group that both have, and nothing of it travels.
    """
    kinds = sets.filter("m = c").select("m", "n", "items")
    filed = lambda rows, keys, end, *more: rows.select(*(F.col(x).alias(f"{x}_{end}") for x in ("n", *more)), F.col("m").alias(end), F.explode(F.expr(keys)).alias("g"))
    small, large = kinds.filter(F.col("n") <= carried), kinds.filter(F.col("n") > carried)
    met = filed(small, near, "a", "items").join(filed(small, far, "b", "items"), "g").filter(turn)
    both = F.array_intersect("items_a", "items_b")
    found = met.withColumn("both", both).filter(F.element_at("both", 1) == F.col("g")).select("a", "b", "n_a", "n_b", F.size("both").cast("long").alias("shared"))
    apart = filed(large, near, "a").join(filed(kinds, far, "b"), "g").filter(turn).select("a", "b").unionAll(filed(small, near, "a").join(filed(large, far, "b"), "g").filter(turn).select("a", "b"))
    across = found.unionAll(_counted(apart, kinds)).filter(enough).select("a", "b", "shared")
    return _written_out(across, sets)


def _written_out(across: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared), a < b, of members, from pairs of their classes and from those inside of a class."""
    inside = sets.groupBy("c").agg(F.max("n").cast("long").alias("shared"), F.count("*").alias("members")).filter("members > 1").select("c", "c", "shared").toDF("a", "b", "shared")
    every = across.unionAll(inside).join(sets.select(F.col("c").alias("a"), F.col("m").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("m").alias("y")), "b")
    return every.filter("a <> b OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def sharing(bridge: DataFrame, member: str, group: str, least: int, carried: int = CARRIED) -> DataFrame:
    """(a, b, shared): members a < b with at least ``least`` groups in common.

    Two such members share one of all but their ``least`` - 1 most common groups, so these, the largest, pair no one.
    """
    sets = _rarest_first(bridge, member, group).filter(F.col("n") >= least)
    first = f"slice(items, 1, n - {least - 1})"
    return _meeting(sets, first, first, "a < b", f"shared >= {least}", carried)


#: Cells of ``sharing_in_blocks`` at most, members of an array, side of a matrix and rows of a frame in its tasks.
CELLS, ARRAY, SIDE, FRAME = 24, 1024, 4096, 1 << 20


def sharing_in_blocks(bridge: DataFrame, member: str, group: str, least: int, side: int = 2048, first: DataFrame | None = None) -> DataFrame:
    """The rows of ``sharing`` where groups are few and hold many members each, so that most members meet; those with a in ``first`` (one column) where given.

    Members of equal groups lie in arrays, which are dealt to cells of about ``side``, or to ``CELLS`` larger ones.  A task counts
    one cell against another in matrices and writes the pairs of members out itself, in frames, so that no pair is shuffled; an
    array travels once for each cell.
    """
    from quaestor.operators.graph import cut

    rows = bridge.select(F.col(member).alias("m"), F.col(group).alias("g")).filter("m IS NOT NULL AND g IS NOT NULL")
    sets = rows.groupBy("m").agg(F.array_sort(F.collect_set("g")).alias("items")).filter(F.size("items") >= least)
    marked = sets.withColumn("f", F.lit(True)) if first is None else sets.join(first.toDF("m").dropna().distinct().withColumn("f", F.lit(True)), "m", "left")
    alike = marked.groupBy("items").agg(F.collect_list(F.struct("m", F.coalesce("f", F.lit(False)).alias("f"))).alias("ms"))
    units = alike.select("items", F.explode(F.expr(f"transform(sequence(1, size(ms), {ARRAY}), k -> slice(ms, k, {ARRAY}))")).alias("ms"))
    units = cut(units.selectExpr("items", "ms.m AS ms", "ms.f AS fs", "exists(ms, x -> x.f) AS any"))
    cells = max(1, min(CELLS, -(-units.count() // side)))
    cell = F.pmod(F.xxhash64(F.col("ms")[0]), F.lit(cells)).cast("int")
    dealt = units.select("*", cell.alias("cell"), F.explode(F.expr(f"sequence(0, {cells - 1})")).alias("other"))
    blocks = dealt.select(F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "items", "ms", "fs", "any").repartition(cells * (cells + 1), "i", "j")
    kind = sets.schema["m"].dataType.simpleString()

    def counted(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, j = key
        held = pd.concat(list(frames), ignore_index=True).sort_values("any", ascending=False, kind="stable")  # two cells
        parts = [_Cell(held[held["cell"] == c]) for c in ((i,) if i == j else (i, j))]
        for x, y, shared in _alike(parts[0], parts[-1], least):
            for low, high, own in _members(parts[0], parts[-1], x, y, shared):
                yield pd.DataFrame({"a": low, "b": high, "shared": own})

    return blocks.groupBy("i", "j").applyInPandas(counted, f"a {kind}, b {kind}, shared long")


class _Cell:
    """Arrays of members with their groups, those that hold a first member before the others, in pieces of ``SIDE``."""

    def __init__(self, rows: pd.DataFrame):
        flat = lambda column: np.concatenate(rows[column].to_list()) if len(rows) else np.array([])
        self.members, self.first, self.size = flat("ms"), flat("fs").astype(bool), rows["ms"].map(len).to_numpy(np.int64)
        self.at, self.any = np.cumsum(self.size) - self.size, rows["any"].to_numpy(bool)
        groups, lengths = flat("items"), rows["items"].map(len).to_numpy(np.int64)
        nth = np.repeat(np.arange(len(rows)), lengths)
        self.pieces = []
        for low in range(0, len(rows), SIDE):
            own = slice(*np.searchsorted(nth, (low, low + SIDE)))
            names, codes = np.unique(groups[own], return_inverse=True)
            order = np.argsort(codes, kind="stable")
            bounds = np.append(np.searchsorted(codes[order], np.arange(len(names))), len(order))
            self.pieces.append((low, min(SIDE, len(rows) - low), names, (nth[own] - low)[order], bounds))


def _alike(left: _Cell, right: _Cell, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of arrays with enough groups in common, in a cell each or, once and with themselves, in one."""
    for low, height, names, rows, at in left.pieces:
        for other, width, others, columns, to in right.pieces:
            if left is right and other < low or not (left.any[low] or right.any[other]):
                continue
            n = np.zeros((height, width), np.int32)
            _, here, there = np.intersect1d(names, others, assume_unique=True, return_indices=True)
            for p, q in zip(here, there):  # an array is once in a group
                n[np.ix_(rows[at[p] : at[p + 1]], columns[to[q] : to[q + 1]])] += 1
            x, y = np.nonzero(n >= least)
            shared, x, y = n[x, y].astype(np.int64), x + low, y + other
            keep = left.any[x] | right.any[y]
            if left is right:
                keep &= x <= y
            yield x[keep], y[keep], shared[keep]


def _members(left: _Cell, right: _Cell, x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, shared), a < b and a first, of the members of pairs of arrays, about ``FRAME`` at a time."""
    number = left.size[x] * right.size[y]
    ends = np.cumsum(number)
    low = 0
    while low < len(x):
        high = max(low + 1, np.searchsorted(ends, ends[low] - number[low] + FRAME, "right"))
        many = number[low:high]
        pair = np.repeat(np.arange(low, high), many)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        wide = right.size[y[pair]]
        p, q = left.at[x[pair]] + k // wide, right.at[y[pair]] + k % wide
        a, b, f, g = left.members[p], right.members[q], left.first[p], right.first[q]
        keep = np.where(a < b, f, g)
        if left is right:  # an array meets itself in both orders
            keep &= (x[pair] != y[pair]) | (a < b)
        yield np.minimum(a, b)[keep], np.maximum(a, b)[keep], shared[pair][keep]
        low = high


def overlapping(bridge: DataFrame, member: str, group: str, share: float, carried: int = CARRIED) -> DataFrame:
    """(a, b, shared): members a < b that share at least ``share`` of the smaller one's groups.

    The smaller one has a shared group among its rarest n - ceil(share * n) + 1, which alone look for others.
    """
    sets = _rarest_first(bridge, member, group)
    first = f"slice(items, 1, n - CAST(ceil({share!r}D * n - 1e-9) AS INT) + 1)"
    return _meeting(sets, first, "items", "n_a < n_b OR n_a = n_b AND a < b", f"shared >= {share!r}D * n_a - 1e-9", carried)


def most_shared(bridge: DataFrame, group: str, member: str, k: int, least: int = 1, members: int = 1, first: int = 100) -> DataFrame:
    """(a, b, shared): the ``k`` pairs a < b of members that most groups hold, ``least`` at least, ties by a and b; members are in ``members`` groups or more.

    ``bridge`` holds a member once a group.  No pair is in more groups than either end.  The pairs of the ``first`` commonest
    members are counted, and what the last of the best ``k`` of them has is a bound: members of fewer groups are in none of the
    best pairs and are left out before the others are written out.
    """
    rows = bridge.select(F.col(group).alias("g"), F.col(member).alias("m"))
    sizes = rows.groupBy("m").agg(F.count("*").alias("f")).filter(F.col("f") >= max(least, members))

    def counted(named: DataFrame) -> DataFrame:
        held = rows.join(named.select("m"), "m", "left_semi")
        both = held.withColumnRenamed("m", "a").join(held.withColumnRenamed("m", "b"), "g").filter("a < b")
        found = both.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
        return found.orderBy(F.col("shared").desc(), "a", "b").limit(k)

    best = [r.shared for r in counted(sizes.orderBy(F.col("f").desc(), "m").limit(first)).collect()]  # ``k`` rows
    return counted(sizes.filter(F.col("f") >= best[-1]) if len(best) == k else sizes)


def best_shared(bridge: DataFrame, group: str, member: str, k: int, pairs_a_task: int = 1_000_000) -> DataFrame:
    """(a, b, shared): the ``k`` pairs a < b of members that most groups hold, ties by a and b.

    Nearly every pair is in one group only, so none is counted before it is dealt to a task, and tasks follow the number of pairs.
    """
    rows = bridge.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    number = rows.groupBy("g").agg(F.count("*").alias("f")).agg(F.sum(F.col("f") * (F.col("f") - 1) / 2)).first()[0] or 0
    both = rows.withColumnRenamed("m", "a").join(rows.withColumnRenamed("m", "b"), "g").filter("a < b").select("a", "b")
    dealt = both.repartition(max(1, int(number // pairs_a_task)), "a", "b")
    return dealt.groupBy("a", "b").agg(F.count("*").alias("shared")).orderBy(F.col("shared").desc(), "a", "b").limit(k)


def unlike(rows: DataFrame, key: str, kind: str, member: str, side: int = 1024, pairs_a_task: int = 4_000_000) -> DataFrame:
    """(a, b, key): every pair of rows of one key and of different kinds by their members a < b, as often as such rows meet.

    Members of a key and kind are dealt to arrays of about ``side``, and an array meets another in a cell, which is all that
    travels.  Cells are dealt evenly, so the pairs of a common key are written out by as many tasks as they need, up to 4 096.
    The result is a square of the members of a key.
    """
    held = rows.select(F.col(key).alias("k"), F.col(kind).alias("t"), F.col(member).alias("m")).dropna()
    sizes = held.groupBy("k", "t").agg(F.count("*").cast("double").alias("f")).groupBy("k").agg((F.sum("f") * F.sum("f") - F.sum(F.col("f") * F.col("f"))).alias("n"))
    tasks = max(1, min(4096, int((sizes.agg(F.sum("n")).first()[0] or 0) / 2 // pairs_a_task)))
    parts = F.ceil(F.count("*").over(Window.partitionBy("k", "t")) / side)
    units = held.withColumn("part", F.pmod(F.xxhash64("m"), parts)).groupBy("k", "t", "part").agg(F.collect_list("m").alias("ms"))
    left, right = units.selectExpr("k", "t AS t_a", "ms AS xs"), units.selectExpr("k", "t AS t_b", "ms AS ys")
    cells = left.join(right.hint("merge"), "k").filter("t_a < t_b").select("k", "xs", "ys").repartition(tasks)
    # Spark keeps what it writes out of a row until the row is done; coalescing, which moves nothing here, makes that row one x with its array
    one = cells.select("k", "ys", F.explode("xs").alias("x")).coalesce(tasks)
    both = one.select("k", "x", F.explode("ys").alias("y")).filter("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("k").alias(key))


def not_among(rows: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Rows whose key is not in ``others`` (one column), as NOT IN has it: none where that holds a null, those with a null key where it is empty.

    NOT IN itself sends all of ``others`` to every task.
    """
    name = others.columns[0]
    state = others.agg(F.count("*").alias("others"), F.count_if(F.col(name).isNull()).alias("unknown"))
    left = rows.join(others.select(F.col(name).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return left.crossJoin(F.broadcast(state)).filter(F.expr("others = 0") | F.expr("unknown = 0") & F.col(key).isNotNull()).select(*rows.columns)  # one row


def both_ends(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, partner, other columns): each undirected edge seen from either end."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("node"), F.col(b).alias("partner"), *rest).unionAll(edges.select(F.col(b).alias("node"), F.col(a).alias("partner"), *rest))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in an order, with their rank.  Spark limits each partition's groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def bucketed(value: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the first bound that the value is below, else the last name."""
    out = F.when(value < bounds[0], names[0])
    for bound, name in zip(bounds[1:], names[1:], strict=False):
        out = out.when(value < bound, name)
    return out.otherwise(names[-1])


def gaps(df: DataFrame, day: str, least: int, within: list[str] | None = None) -> DataFrame:
    """(from_day, to_day, days): distances of at least ``least`` days between consecutive distinct full dates."""
    days = df.select(*(within or []), F.try_to_date(day, "yyyy-MM-dd").alias("to_day")).filter("to_day IS NOT NULL").distinct()
    before = F.lag("to_day").over(Window.partitionBy(*(within or [F.lit(0)])).orderBy("to_day"))
    found = days.withColumn("from_day", before).withColumn("days", F.datediff("to_day", "from_day").cast("long"))
    return found.filter(F.col("days") >= least).select(*(within or []), "from_day", "to_day", "days")
