"""Connected components of a table of links: distributed stars, or one bounded task for few links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}
    kind = None

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(a) if parent.setdefault(a, a) != a else a, find(b) if parent.setdefault(b, b) != b else b
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    for start in range(0, len(nodes), 65536):
        some = nodes[start : start + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([find(x) for x in some], kind)], names=["node", "component"])


def components(links: DataFrame, one_task: int = 500_000) -> DataFrame:
    """(node, component): each node that has a link, with the smallest node it reaches.

    ``links`` has two columns of one orderable type; direction, repeats, loops and nulls do not
    matter.  Up to ``one_task`` distinct links are united in a single task, which that number
    bounds to about 200 MB.  More take large-star and small-star steps in turn: each joins links
    with one minimum per node, so a node with very many links is a skewed join side that Spark
    splits, never a collected group; steps are written tables.
    """
    a, b = links.columns
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    pairs = written(pairs, "links")
    before = _digest(pairs)
    if before[0] <= one_task:
        kind = pairs.schema["a"].dataType.simpleString()
        return pairs.coalesce(1).mapInArrow(_united, f"node {kind}, component {kind}")
    while True:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.expr("IF(b = m, a, b)").alias("a"), F.col("m").alias("b"))
        roots = lower.select("a", F.col("m").alias("b"))
        pairs = written(small.unionAll(roots).distinct(), "links")
        after = _digest(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
