"""Near-duplicate vectors by the epsilon grid order join.

Unit vectors have cosine >= c exactly where their distance is at most epsilon = sqrt(2 - 2c).
Vectors are rotated onto the principal axes of the data, which keeps distances, and sorted by
the grid cells, of side epsilon, of their ``leading`` coordinates: the epsilon grid order.  The
sorted sequence is cut into blocks; ``fan`` neighbouring blocks form an interval, ``fan``
neighbouring intervals a larger one.  Pairs of intervals are joined from the top: a pair whose
bounding boxes, or whose centres and radii, lie further apart than epsilon is skipped, others
go on as the pairs of their parts, down to pairs of blocks, and inside those to intervals of
``_LEAF`` rows.

Rows of two intervals that remain are bounded before they are compared: the product of two unit
vectors is at most that of their leading coordinates plus that of the norms of the rest, one
short matrix product in single precision.  Only pairs whose bound reaches the threshold, less a
margin for that precision, are compared as they came, in double precision, so rotation and
pruning bear no rounding into the result.  Leading coordinates for the bound are as many as hold
``_HELD`` of the vectors' length on average.  ``pruning`` tells what share of pairs each step leaves.

Data without any nearness leave all pairs of blocks.  A block therefore grows with the root of
the number of vectors (to ``block_bytes``), so that copies of blocks for their pairs grow with
its power of 1.5; each pair of blocks is one group of its own, which one task holds.

Equal vectors collapse first, with their number, so copies cost one row.  A pair of blocks
answers with each vector's number of links and with links that span its components, never
with all its pairs.

Empty cases: vectors that are null, zero, or hold null or non-finite components link with
nothing, and so do vectors of different lengths.  Rows that share an id are one node that has
the links of each.  Null ids are ignored as neighbours' smallest ids.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import written

#: Rows of the smallest interval, and rows of a block for each root of the number of vectors.
_LEAF, _ROOT = 64, 16

#: Share of the vectors' squared length that the leading coordinates of the bound hold.
_HELD = 0.45

_BLOCK = "block long, size int, box_low array<double>, box_high array<double>, centre array<double>, radius double"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _axes(nodes: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes, as columns, of the unit vectors about their mean, and the mean squared length that the first of them
    hold; only sums of one matrix per task leave the executors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.hstack([_unit(_matrix(batch.column(0))), np.ones((batch.num_rows, 1))])
                total += x.T @ x
        k = np.arange((dims + 1) ** 2)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total.ravel())], names=["k", "v"])

    sums = {r.k: r.v for r in nodes.select("v").mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    m = np.array([sums[k] for k in range((dims + 1) ** 2)]).reshape(dims + 1, dims + 1)
    n, mean = m[dims, dims], m[:dims, dims] / m[dims, dims]
    axes = np.linalg.eigh(m[:dims, :dims] / n - np.outer(mean, mean))[1][:, ::-1]
    return axes, np.cumsum(np.einsum("ik,ij,jk->k", axes, m[:dims, :dims] / n, axes))


def _joined_intervals(blocks: DataFrame, count: int, fan: int, epsilon: float) -> DataFrame:
    """Pairs (a, b) of blocks, a <= b, that the recursive join of intervals cannot rule out."""
    slack = epsilon + 1e-9
    levels = [blocks.select("block", "box_low", "box_high", "centre", "radius")]
    size = count
    while size > 1:
        below = levels[-1].withColumn("up", F.expr(f"block div {fan}"))
        boxes = below.select("up", F.posexplode(F.arrays_zip("box_low", "box_high")).alias("d", "z")).groupBy("up", "d").agg(F.min("z.box_low").alias("low"), F.max("z.box_high").alias("high"))
        up = boxes.groupBy("up").agg(F.array_sort(F.collect_list(F.struct("d", "low", "high"))).alias("z"))
        levels.append(up.select(F.col("up").alias("block"), F.col("z.low").alias("box_low"), F.col("z.high").alias("box_high"), F.lit(None).cast("array<double>").alias("centre"), F.lit(None).cast("double").alias("radius")))
        size = -(-size // fan)
    pairs = levels[-1].select(F.col("block").alias("a"), F.col("block").alias("b"))
    far = "sqrt(aggregate(zip_with(zip_with(low_a, high_b, (x, y) -> x - y), zip_with(low_b, high_a, (x, y) -> x - y), (x, y) -> pow(greatest(0D, x, y), 2)), 0D, (s, x) -> s + x))"
    centres = "sqrt(aggregate(zip_with(centre_a, centre_b, (x, y) -> pow(x - y, 2)), 0D, (s, x) -> s + x)) - radius_a - radius_b"
    for k, level in reversed(list(enumerate(levels))):
        if k < len(levels) - 1:
            part = F.expr(f"sequence(0, {fan - 1})")
            pairs = pairs.select(F.explode(F.transform(part, lambda x: F.col("a") * fan + x)).alias("a"), "b").select("a", F.explode(F.transform(part, lambda x: F.col("b") * fan + x)).alias("b")).filter("a <= b")
        side = lambda s: level.select(F.col("block").alias(s), F.col("box_low").alias(f"low_{s}"), F.col("box_high").alias(f"high_{s}"), F.col("centre").alias(f"centre_{s}"), F.col("radius").alias(f"radius_{s}"))  # noqa: B023, E731
        met = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.expr(f"{far} <= {slack!r}"))
        pairs = met.filter(F.expr(f"centre_a IS NULL OR {centres} <= {slack!r}")).select("a", "b")
    return pairs


def _leaves(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lower and upper corners of the intervals of ``_LEAF`` rows."""
    starts = np.arange(0, len(y), _LEAF)
    return starts, np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)


class _Side:
    """A block as it travels: nodes, their copies, vectors, and what bounds their products."""

    def __init__(self, row: dict, rotation: np.ndarray, short: int):
        self.nodes = np.frombuffer(row["nodes"], "S16")
        self.copies = np.frombuffer(row["copies"], np.int64)
        size = len(self.nodes)
        self.unit = _unit(np.frombuffer(row["data"], np.float64 if len(row["data"]) == size * len(rotation) * 8 else np.float32).reshape(size, -1).astype(np.float64))
        y = self.unit @ rotation
        self.starts, self.low, self.high = _leaves(y)
        rest = np.sqrt(np.maximum(0, 1 - (y[:, :short] ** 2).sum(1)))
        self.bound = np.hstack([y[:, :short], rest[:, None]]).astype(np.float32)
        self.links = np.zeros(size, np.int64)


class _Forest:
    """Components of the numbers below ``size``; ``joins`` answers with links that span what it unites."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def joins(self, x: np.ndarray, y: np.ndarray) -> Iterator[int]:
        """Places of the pairs (x, y) that united two components."""
        p, q = self.label[x], self.label[y]
        new = np.flatnonzero(p != q)
        if not len(new):
            return
        low, high = np.minimum(p, q)[new], np.maximum(p, q)[new]
        _, once = np.unique(low * len(self.label) + high, return_index=True)
        parent: dict[int, int] = {}

        def find(k: int) -> int:
            while (up := parent.get(k, k)) != k:
                parent[k] = k = parent.get(up, up)
            return k

        for k in once.tolist():
            one, other = find(int(low[k])), find(int(high[k]))
            if one != other:
                parent[max(one, other)] = min(one, other)
                yield int(new[k])
        if parent:
            table = np.arange(len(self.label))
            for k in list(parent):
                table[k] = find(k)
            self.label = table[self.label]


def _compare(cosine: float, epsilon: float, rotation, short: int):
    names = ["node", "links", "other", "pairs", "met", "compared"]

    def compare(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        sides = [_Side(r, rotation.value, short) for r in rows]
        a, b = sides[0], sides[-1]
        own, shift, slack = a is b, 0 if a is b else len(a.nodes), epsilon + 1e-9
        forest, edges = _Forest(shift + len(b.nodes)), []
        met = compared = 0
        for leaf, start in enumerate(a.starts.tolist()):
            end = min(start + _LEAF, len(a.nodes))
            gap = np.maximum(0, np.maximum(b.low - a.high[leaf], a.low[leaf] - b.high))
            near = (gap * gap).sum(1) <= slack * slack
            if own:
                near[:leaf] = False
            if not near.any():
                continue
            others = np.flatnonzero(np.repeat(near, _LEAF)[: len(b.nodes)])
            every = len(others) == len(b.nodes)
            met += (end - start) * len(others) - own * ((end - start) * (end - start + 1) // 2)
            x, y = np.nonzero(a.bound[start:end] @ (b.bound if every else b.bound[others]).T >= cosine - 1e-5)
            x, y = start + x, y if every else others[y]
            if own:
                x, y = x[x < y], y[x < y]
            compared += len(x)
            linked = np.empty(len(x), bool)
            for k in range(0, len(x), 16384):
                linked[k : k + 16384] = np.einsum("ij,ij->i", a.unit[x[k : k + 16384]], b.unit[y[k : k + 16384]]) >= cosine
            x, y = x[linked], y[linked]
            if len(x):
                a.links += np.bincount(x, b.copies[y], len(a.nodes)).astype(np.int64)
                b.links += np.bincount(y, a.copies[x], len(b.nodes)).astype(np.int64)
                edges += [(a.nodes[x[k]], b.nodes[y[k]]) for k in forest.joins(x, y + shift)]
        node, links = [], []
        for side in {id(s): s for s in (a, b)}.values():
            hit = np.flatnonzero(side.links)
            node += [_bytes16(n) for n in side.nodes[hit]]
            links += side.links[hit].tolist()
        node, links, other = node + [_bytes16(e[0]) for e in edges], links + [0] * len(edges), [None] * len(node) + [_bytes16(e[1]) for e in edges]
        size = len(a.nodes) * (len(a.nodes) - 1) // 2 if own else len(a.nodes) * len(b.nodes)
        none = [None] * len(node)
        columns = [[*node, None], [*links, 0], [*other, None], [*none, size], [*none, met], [*none, compared]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * 3], strict=True)], names=names)

    return compare


def _bytes16(node) -> bytes:
    return bytes(node).ljust(16, b"\0")  # numpy drops zeros at the end


def _nodes(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node), node null for a vector that links with nothing, and distinct vectors (node, copies, smallest, v, dims)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).withColumn("v", F.expr("transform(v, x -> x + 0D)"))
    sound = "size(v) > 0 AND exists(v, x -> x != 0D) AND forall(v, x -> coalesce(x = x AND abs(x) < double('Infinity'), false))"
    rows = rows.withColumn("v", F.when(F.coalesce(F.expr(sound), F.lit(False)), F.col("v")))
    rows = written(rows.withColumn("node", F.expr("IF(v IS NULL, NULL, substr(unhex(sha2(to_json(struct(v)), 256)), 1, 16))")), "vectors")
    groups = rows.filter("v IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("smallest"), F.first("v").alias("v"))
    return rows.select("vec_id", "node"), written(groups.withColumn("dims", F.size("v")), "nodes")


def _found(nodes: DataFrame, cosine: float, **options) -> DataFrame | None:
    """What all pairs of blocks answer, a written table; None where there is no vector."""
    found = None
    for dims in sorted(r.dims for r in nodes.select("dims").distinct().collect()):  # vectors of different lengths never meet
        mine = _pairs_of(nodes.filter(F.col("dims") == dims), dims, cosine, **options)
        found = mine if found is None else found.unionAll(mine)
    return None if found is None else written(found, "found")


def pruning(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, leading: int = 8, block_rows: int = 1024, block_bytes: int = 16 << 20, fan: int = 8) -> DataFrame:
    """One row: pairs of distinct vectors of one length, those left by boxes of blocks, by boxes of intervals (met) and by
    the bound on their product (compared)."""
    _, nodes = _nodes(vectors, vec_id, embedding)
    found = _found(nodes, cosine, leading=leading, block_rows=block_rows, block_bytes=block_bytes, fan=fan)
    every = nodes.groupBy("dims").count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0)).alias("all_pairs"))
    if found is None:
        return every.select("all_pairs", *(F.lit(0).cast("long").alias(c) for c in ("pairs", "met", "compared")))
    return every.crossJoin(found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "met", "compared"))))  # one row each


def near_duplicate_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, leading: int = 8, block_rows: int = 1024, block_bytes: int = 16 << 20, fan: int = 8,
) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept."""
    rows, nodes = _nodes(vectors, vec_id, embedding)
    found = _found(nodes, cosine, leading=leading, block_rows=block_rows, block_bytes=block_bytes, fan=fan)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = found.filter("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    spans = components(found.filter("other IS NOT NULL").select("node", "other")).toDF("node", "part")
    labelled = nodes.select("node", "copies", "smallest").join(spans, "node", "left").withColumn("part", F.coalesce("part", "node")).join(linked, "node", "left")
    least = labelled.groupBy("part").agg(F.min("smallest").alias("component_id"))
    answer = labelled.join(least, "part").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(answer, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.expr("IF(node IS NULL, vec_id, component_id)").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _pairs_of(nodes: DataFrame, dims: int, cosine: float, leading: int, block_rows: int, block_bytes: int, fan: int) -> DataFrame:
    spark = nodes.sparkSession
    epsilon = float(np.sqrt(2 - 2 * cosine))
    axes, held = _axes(nodes, dims)
    leading, short = min(leading, dims), int(min(dims, np.searchsorted(held, _HELD) + 1))
    rotation = spark.sparkContext.broadcast(np.ascontiguousarray(axes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = _unit(_matrix(batch.column("v"))) @ rotation.value[:, :leading]
                cells = pa.array(np.floor(y / epsilon).astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "copies", "v")), cells], names=["node", "copies", "v", "cells"])

    placed = nodes.select("node", "copies", "v").mapInArrow(place, "node binary, copies long, v array<double>, cells array<int>")
    many = nodes.count()
    rows = int(min(max(block_rows, _ROOT * np.sqrt(many)), max(block_rows, block_bytes // (8 * dims))))
    count = max(1, -(-many // rows))
    ordered = placed.repartitionByRange(count, "cells", "node").sortWithinPartitions("cells", "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            v = np.concatenate([_matrix(b.column("v")) for b in held])
            node = b"".join(x for b in held for x in b.column("node").to_pylist())
            copies = np.concatenate([b.column("copies").to_numpy() for b in held])
            y = _unit(v) @ rotation.value
            centre, single = y.mean(0), v.astype(np.float32)
            row = {
                "block": [TaskContext.get().partitionId()], "size": [len(v)], "box_low": [y.min(0).tolist()], "box_high": [y.max(0).tolist()], "centre": [centre.tolist()],
                "radius": [float(np.sqrt(((y - centre) ** 2).sum(1)).max())], "nodes": [node], "copies": [copies.tobytes()], "data": [(single if (single == v).all() else v).tobytes()],
            }
            yield pa.RecordBatch.from_arrays([pa.array(row[n], t) for n, t in kinds.items()], names=list(row))

    real = pa.list_(pa.float64())
    kinds = {"block": pa.int64(), "size": pa.int32(), "box_low": real, "box_high": real, "centre": real, "radius": pa.float64(), "nodes": pa.binary(), "copies": pa.binary(), "data": pa.binary()}
    blocks = written(ordered.mapInArrow(cut, f"{_BLOCK}, nodes binary, copies binary, data binary"), "blocks")
    pairs = written(_joined_intervals(blocks, count, fan, epsilon), "pairs")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    tiles = max(1, min(pairs.count(), 32 * count))
    met = sides.join(blocks.select("block", "nodes", "copies", "data"), "block").repartition(tiles, "a", "b")
    return met.groupBy("a", "b").applyInArrow(_compare(cosine, epsilon, rotation, short), "node binary, links long, other binary, pairs long, met long, compared long")
