"""The weighted entity graph: canonical edges, statistics, centralities, communities, paths.

Everything that is a sum over edges or neighbours is a DataFrame plan; loops run until they have
settled and write their state each round.  Path centralities run one source per row in Python
tasks over a broadcast adjacency, only behind a check of its size; a larger graph takes the
sources' frontiers as a DataFrame, round by round, some sources at a time.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators.pairs import both_ends


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quaestor-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The table written to a scratch path and read back, so that loops keep short plans."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def canonical_edges(edges: DataFrame, nodes: DataFrame, resolutions: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """(a, b, weight), a < b: both ends resolved one step, loops dropped, ends that exist (and have the type), parallel edges summed."""
    e = edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b"), F.col(edges.columns[2]).alias("weight"))
    if resolutions is not None:
        for end in ("a", "b"):
            m = resolutions.select(F.col(resolutions.columns[0]).alias(end), F.col(resolutions.columns[1]).alias("to"))
            e = e.join(m, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    known = nodes.filter(F.col("type") == kind) if kind else nodes
    for end in ("a", "b"):
        e = e.join(known.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return e.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest reachable node, by minimum labels with pointer jumping."""
    ends = cut(both_ends(edges.select("a", "b"), "a", "b"))
    labels = cut(ends.groupBy("node").agg(F.least(F.min("partner"), F.col("node")).alias("component")))
    while True:
        seen = labels.withColumnRenamed("node", "partner")
        near = ends.join(seen, "partner").groupBy("node").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = labels.join(near, "node").join(jump, "component").select("node", F.least("near", "far").alias("component"))
        new = cut(new)
        moved = new.join(labels.withColumnRenamed("component", "old"), "node").filter("component <> old").head(1)
        labels = new
        if not moved:
            return labels


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, average degree and weighted degree."""
    degree = both_ends(edges, "a", "b").groupBy("node").agg(F.count("*").alias("d"), F.sum("weight").alias("w"))
    sums = degree.agg(F.count("*").alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.avg("d").alias("avg_degree"), F.avg("w").alias("avg_weighted_degree"))
    parts = components(edges).agg(F.countDistinct("component").alias("components"))
    return sums.crossJoin(parts).withColumn("density", F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, weight, score): degree over the number of other nodes."""
    d = both_ends(edges, "a", "b").groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))
    n = d.agg((F.count("*") - 1).alias("others"))
    return d.crossJoin(n).select("node", "degree", "weight", F.when(F.col("others") > 0, F.col("degree") / F.col("others")).otherwise(0.0).alias("score"))


def eigenvector_centrality(edges: DataFrame, rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """(node, score) by power iteration on weights plus the identity; zeros where it does not settle."""
    ends = cut(both_ends(edges, "a", "b"))
    x = ends.select("node").distinct().withColumn("score", F.lit(1.0))
    n = x.count()
    for _ in range(rounds):
        pushed = ends.join(x.withColumnRenamed("node", "partner"), "partner").groupBy("node").agg(F.sum(F.col("score") * F.col("weight")).alias("y"))
        raw = cut(x.join(pushed, "node", "left").select("node", F.col("score").alias("old"), (F.col("score") + F.coalesce("y", F.lit(0.0))).alias("y")))
        norm = raw.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        change = raw.agg(F.sum(F.abs(F.col("y") / norm - F.col("old")))).first()[0]
        x = raw.select("node", (F.col("y") / norm).alias("score"))
        if change < n * tolerance:
            return x
    return x.withColumn("score", F.lit(0.0))


def path_centralities(edges: DataFrame, most_edges: int = 1_000_000) -> DataFrame:
    """(node, betweenness, closeness), weights as distances, by Brandes' sums over some sources at a time.

    The adjacency of at most ``most_edges`` edges is broadcast; a larger graph is never collected.
    """
    if edges.count() > most_edges:
        return _centralities_by_frontiers(edges, most_edges)
    sources = both_ends(edges, "a", "b").select("node").distinct()
    kind = sources.schema["node"].dataType.simpleString()
    rows = edges.select("a", "b", F.col("weight").cast("double")).toPandas()  # bounded by ``most_edges``
    names, place = np.unique(np.concatenate([rows["a"], rows["b"]]), return_inverse=True)
    n, half = len(names), len(rows)
    head = np.concatenate([place[half:], place[:half]])
    order = np.argsort(head, kind="stable")
    tail, head, weight = place[order], head[order], np.tile(rows["weight"].to_numpy(float), 2)[order]
    hubs = _Hubs.of(tail, head, weight)
    shared = edges.sparkSession.sparkContext.broadcast((names, hubs) if hubs else (names, tail, head, weight))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, *ends = shared.value
        between, close = np.zeros(n), np.zeros(n)
        for frame in frames:
            picked = np.searchsorted(names, frame["node"].to_numpy())
            if hubs_alone:
                for s in picked:
                    ends[0].add(s, between, close)
                continue
            turn = max(1, min(64, 4_000_000 // max(1, len(ends[0]))))
            for k in range(0, len(picked), turn):
                _add_sources(picked[k : k + turn], *ends, between, close)
        used = np.flatnonzero((between != 0) | (close != 0))
        for k in range(0, len(used), 10_000):
            own = used[k : k + 10_000]
            yield pd.DataFrame({"node": names[own], "betweenness": between[own], "closeness": close[own]})

    # every source is as much work as any other, so they are dealt to tasks evenly; each task hands on a row a node
    hubs_alone = hubs is not None
    tasks = min(n // 128, max(96, 20_000_000 // max(1, n))) if hubs_alone else min(2048, n // 128)
    dealt = sources.repartition(max(1, tasks))
    found = dealt.mapInPandas(run, f"node {kind}, betweenness double, closeness double")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    every = found.unionAll(sources.select("node", F.lit(0.0), F.lit(0.0)))
    return every.groupBy("node").agg((F.sum("betweenness") * scale).alias("betweenness"), F.sum("closeness").alias("closeness"))


class _Hubs:
    """A graph whose nodes but for a few hubs have all their neighbours among the hubs, and 32 at most.

    Distances and numbers of shortest paths between hubs, also through the other nodes, are computed once.  A source then takes
    each end of the other nodes a few times, however long the paths are.
    """

    MOST, ENDS = 512, 32

    @classmethod
    def of(cls, tail: np.ndarray, head: np.ndarray, weight: np.ndarray) -> _Hubs | None:
        """None where hubs would be too many, or where weights are too small for sums to tell paths apart.  Ends are sorted by ``head``."""
        if not len(head) or weight.min() <= 1e-9:
            return None
        degree = np.bincount(head)
        n, starts = len(degree), np.cumsum(degree) - degree
        rank = np.empty(n, np.int64)
        rank[np.lexsort((np.arange(n), degree))] = np.arange(n)
        plain = (rank < np.minimum.reduceat(rank[tail], starts)) & (degree <= cls.ENDS)  # no two of them are neighbours
        return cls(tail, head, weight, degree, starts, plain) if n - plain.sum() <= cls.MOST else None

    def __init__(self, tail, head, weight, degree, starts, plain):
        self.hubs = np.flatnonzero(~plain)
        h, self.n = len(self.hubs), len(degree)
        self.place = np.full(self.n, -1)
        self.place[self.hubs] = np.arange(h)
        wide = np.where(degree <= 8, degree, 1 << np.ceil(np.log2(np.maximum(degree, 1))).astype(int))
        # nodes of about as many ends lie together, a row an end; missing ends lead to a hub of no paths, the last one
        self.groups = []
        for size in np.unique(wide[plain]):
            nodes = np.flatnonzero(plain & (wide == size))
            nth = np.arange(size)[:, None]
            at = np.minimum(starts[nodes] + nth, len(tail) - 1)
            held = nth < degree[nodes]
            self.groups.append((nodes, np.where(held, self.place[tail[at]], h), np.where(held, weight[at], 0.0)))
        step, many = np.full((h + 1, h + 1), np.inf), np.zeros((h + 1, h + 1))
        direct = ~plain[tail] & ~plain[head]
        parts = [(self.place[tail[direct]], self.place[head[direct]], weight[direct])]
        parts += [(to[i], to[j], w[i] + w[j]) for _, to, w in self.groups for i in range(len(to)) for j in range(len(to)) if i != j]
        for a, b, w in parts:
            np.minimum.at(step, (a, b), w)
        for a, b, w in parts:
            np.add.at(many, (a, b), (w <= step[a, b] + 1e-12).astype(float))
        step, many = step[:h, :h], many[:h, :h]
        np.fill_diagonal(step, np.inf)
        np.fill_diagonal(many, 0.0)
        far = step.copy()
        np.fill_diagonal(far, 0.0)
        for k in range(h):
            np.minimum(far, far[:, k, None] + far[k], out=far)
        paths = np.zeros((h, h))
        for s in range(h):
            onward = many * (far[s][:, None] + step <= far[s] + 1e-12)
            now = np.zeros(h)
            now[s] = 1.0
            while now.any():  # paths of one step more
                paths[s] += now
                now = now @ onward
        self.far, self.paths = far, paths

    def add(self, s: int, between: np.ndarray, close: np.ndarray) -> None:
        """Adds the shares of one source."""
        h = len(self.hubs)
        far, paths = np.full(h + 1, np.inf), np.zeros(h + 1)
        if self.place[s] >= 0:
            far[:h], paths[:h] = self.far[self.place[s]], self.paths[self.place[s]]
        else:
            to, w = next((to[:, k], w[:, k]) for nodes, to, w in self.groups if (k := min(np.searchsorted(nodes, s), len(nodes) - 1)) >= 0 and nodes[k] == s)
            to, w = to[to < h], w[to < h]
            every = self.far[to] + w[:, None]
            far[:h] = every.min(axis=0)
            paths[:h] = np.where(every <= far[:h] + 1e-12, self.paths[to], 0.0).sum(axis=0)
        reached, total, ahead, kept = paths > 0, 0.0, np.zeros(h + 1), []
        others = int(reached.sum())
        total = far[reached].sum()
        for nodes, to, w in self.groups:
            every = far[to]
            every += w
            distance = every.min(axis=0)
            number = (paths[to] * (every <= distance + 1e-12)).sum(axis=0)
            k = np.searchsorted(nodes, s)
            if k < len(nodes) and nodes[k] == s:
                distance[k], number[k] = 0.0, 0.0
                others += 1
            one = number > 0
            others += int(one.sum())
            total += distance.sum(where=one)
            part = np.divide(1.0, number, out=np.zeros(len(nodes)), where=one)
            ahead += np.bincount(to.ravel(), ((every <= distance + 1e-12) * part).ravel(), h + 1)
            kept.append((distance, number))
        own = np.divide(1.0, paths[:h], out=np.zeros(h), where=reached[:h])
        share = np.append((self.paths * (far[:h, None] + self.far <= far[:h] + 1e-12)) @ (own + ahead[:h]), 0.0)
        found = paths[:h] * (share[:h] - own)
        if self.place[s] >= 0:
            found[self.place[s]] = 0.0
        between[self.hubs] += found
        for (nodes, to, w), (distance, number) in zip(self.groups, kept):
            onward = share[to] * (distance + w <= far[to] + 1e-12)  # nodes that lead on to hubs
            between[nodes] += number * onward.sum(axis=0)
        others -= 1
        if total > 0:
            close[s] += others / total * others / max(1, self.n - 1)


#: Rounds after which sources whose distances still change are followed one by one.
ROUNDS = 64


def _add_sources(sources: np.ndarray, tail: np.ndarray, head: np.ndarray, weight: np.ndarray, between: np.ndarray, close: np.ndarray) -> None:
    """Adds the shares of some sources.  Ends are sorted by ``head``; each node has one.  Each round takes all ends at once, and there are as many as the longest shortest path has edges."""
    n, width = len(between), len(sources)
    starts, own = np.searchsorted(head, np.arange(n)), (sources, np.arange(width))
    distance = np.full((n, width), np.inf)
    distance[own] = 0.0
    for _ in range(ROUNDS if weight.min() > 1e-9 else 0):
        near = np.minimum.reduceat(distance[tail] + weight[:, None], starts)
        if not (near < distance - 1e-12).any():
            break
        np.minimum(distance, near, out=distance)
    else:
        for s in sources:
            _add_source(s, tail, head, weight, between, close)
        return
    reached = np.isfinite(distance)
    onward = np.nonzero(reached[tail] & (np.abs(distance[tail] + weight[:, None] - np.where(reached, distance, 0.0)[head]) <= 1e-12))
    first, last = tail[onward[0]] * width + onward[1], head[onward[0]] * width + onward[1]  # the ends on shortest paths
    paths = np.zeros(n * width)
    step = np.zeros(n * width)
    step[sources * width + own[1]] = 1.0
    while step.any():  # paths of one end more
        paths += step
        step = np.bincount(last, step[first], n * width)
    share = np.zeros(n * width)
    step = np.divide(1.0, paths, out=np.zeros(n * width), where=paths > 0)
    while (step := np.bincount(first, step[last], n * width)).any():
        share += step
    share = (share * paths).reshape(n, width)
    share[own] = 0.0
    between += share.sum(axis=1)
    others, total = reached.sum(axis=0) - 1, np.where(reached, distance, 0.0).sum(axis=0)
    np.add.at(close, sources, np.divide(others * others / max(1, n - 1), total, out=np.zeros(width), where=total > 0))


def _add_source(s: int, tail: np.ndarray, head: np.ndarray, weight: np.ndarray, between: np.ndarray, close: np.ndarray) -> None:
    """The same for one source, nearest node first."""
    n = len(between)
    starts = np.searchsorted(head, np.arange(n + 1))  # a node's ends lead to its neighbours too
    distance, paths, before, order, heap, done = {s: 0.0}, {s: 1.0}, {}, [], [(0.0, 0, s)], set()
    tick = 0
    while heap:
        d, _, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        at = slice(starts[v], starts[v + 1])
        for w, reach in zip(tail[at].tolist(), (d + weight[at]).tolist()):
            if w not in distance or reach < distance[w] - 1e-12:
                distance[w], paths[w], before[w] = reach, paths[v], [v]
                tick += 1
                heapq.heappush(heap, (reach, tick, w))
            elif abs(reach - distance[w]) <= 1e-12 and w not in done:
                paths[w] += paths[v]
                before[w].append(v)
    total = sum(distance[v] for v in order)
    close[s] += (len(order) - 1) / total * (len(order) - 1) / (n - 1) if total > 0 and n > 1 else 0.0
    share = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before.get(w, ()):
            share[v] += paths[v] / paths[w] * (1 + share[w])
        if w != s:
            between[w] += share[w]


def _centralities_by_frontiers(edges: DataFrame, rows: int) -> DataFrame:
    """The same sums with the state of about ``rows`` (source, node) pairs at a time as a table."""
    ends = cut(both_ends(edges.select("a", "b", F.col("weight").cast("double")), "a", "b"))
    nodes = cut(ends.select("node").distinct())
    n = nodes.count()
    turns = max(1, -(-n * n // max(rows, n)))
    out = None
    for turn in range(turns):
        sources = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(turns)) == turn)
        distance = cut(sources.select(F.col("node").alias("s"), "node", F.lit(0.0).alias("d")))
        front = distance
        while front.head(1):
            reach = front.join(ends, "node").groupBy("s", F.col("partner").alias("node")).agg(F.min(F.col("d") + F.col("weight")).alias("d"))
            known = distance.withColumnRenamed("d", "old")
            front = cut(reach.join(known, ["s", "node"], "left").filter("old IS NULL OR d < old - 1e-12").select("s", "node", "d"))
            distance = cut(distance.join(front.select("s", "node"), ["s", "node"], "left_anti").unionByName(front))
        # edges of the shortest paths
        onward = distance.join(ends, "node").join(distance.select("s", F.col("node").alias("partner"), F.col("d").alias("far")), ["s", "partner"])
        onward = cut(onward.filter("abs(d + weight - far) <= 1e-12").select("s", "node", "partner"))
        paths = distance.select("s", "node", (F.col("d") == 0).cast("double").alias("paths"))
        paths = _settled(paths, lambda p: onward.join(p, ["s", "node"]).groupBy("s", F.col("partner").alias("node")).agg(F.sum("paths").alias("paths")), "paths", "d = 0", distance)
        counted = cut(onward.join(paths, ["s", "node"]).join(paths.toDF("s", "partner", "theirs"), ["s", "partner"]).select("s", "node", "partner", (F.col("paths") / F.col("theirs")).alias("part")))
        shares = distance.select("s", "node", F.lit(0.0).alias("share"))
        shares = _settled(shares, lambda x: counted.join(x.toDF("s", "partner", "share"), ["s", "partner"]).groupBy("s", "node").agg(F.sum(F.col("part") * (1 + F.col("share"))).alias("share")), "share", "false", distance)
        total = distance.groupBy("s").agg((F.count("*") - 1).alias("others"), F.sum("d").alias("total"))
        close = total.select(F.col("s").alias("node"), F.lit(0.0).alias("betweenness"), F.when((F.col("total") > 0) & F.lit(n > 1), F.col("others") / F.col("total") * F.col("others") / (n - 1)).otherwise(0.0).alias("closeness"))
        between = shares.filter("s <> node").groupBy("node").agg(F.sum("share").alias("betweenness")).withColumn("closeness", F.lit(0.0))
        found = cut(close.unionByName(between))
        out = found if out is None else out.unionByName(found)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return out.groupBy("node").agg((F.sum("betweenness") * scale).alias("betweenness"), F.sum("closeness").alias("closeness"))


def _settled(start: DataFrame, step, value: str, fixed: str, distance: DataFrame) -> DataFrame:
    """(s, node, value): ``step`` repeated until no value changes, which takes as many rounds as the longest path has edges."""
    now = cut(start)
    every = distance.select("s", "node", F.expr(fixed).alias("fixed")).join(start.withColumnRenamed(value, "first"), ["s", "node"])
    every = cut(every)
    while True:
        new = cut(every.join(step(now), ["s", "node"], "left").select("s", "node", F.expr(f"IF(fixed, first, coalesce({value}, 0D))").alias(value)))
        changed = new.join(now.withColumnRenamed(value, "old"), ["s", "node"]).filter(F.abs(F.col(value) - F.col("old")) > 1e-9 * F.abs(F.col("old"))).head(1)
        now = new
        if not changed:
            return now


def communities(edges: DataFrame, least: int = 2) -> DataFrame:
    """(node, community, size) by modularity: nodes move to the neighbouring community of most gain, then communities become nodes.

    A community's name is its smallest node.  Some nodes, picked by a hash, move at once; a round that does not raise the
    modularity is undone and fewer move, down to a single one; levels follow until none moves a node.  Results repeat exactly.
    """
    ends = both_ends(edges.select("a", "b", F.col("weight").cast("double")), "a", "b")
    labels = cut(ends.select("node").distinct().withColumn("community", F.col("node")))
    ends = cut(ends)
    while True:
        moved = _moved(ends)
        if moved is None:
            break
        names = moved.groupBy("community").agg(F.min("node").alias("name"))
        moved = cut(moved.join(names, "community").select("node", F.col("name").alias("community")))
        labels = cut(labels.join(moved.toDF("community", "to"), "community").select("node", F.col("to").alias("community")))
        ends = cut(ends.join(moved.toDF("node", "x"), "node").join(moved.toDF("partner", "y"), "partner").groupBy(F.col("x").alias("node"), F.col("y").alias("partner")).agg(F.sum("weight").alias("weight")))
    names = labels.groupBy("community").agg(F.min("node").alias("name"), F.count("*").alias("size")).filter(F.col("size") >= least)
    return labels.join(names, "community").select("node", F.col("name").alias("community"), "size")


def _moved(ends: DataFrame) -> DataFrame | None:
    """(node, community) after local moves in a graph of ends (loops counted once), None if no node moves."""
    degree = cut(ends.groupBy("node").agg(F.sum("weight").alias("k")))
    all_weight = degree.agg(F.sum("k")).first()[0]
    if not all_weight:
        return None
    others = ends.filter("node <> partner")
    loops = ends.filter("node = partner").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    wants = (F.col("gain") > F.col("stay")) & (F.col("best") != F.col("community"))

    def state(labels: DataFrame) -> tuple[DataFrame, float, int | None]:
        """Labels with each node's best move, the modularity of the labels, and the node that gains most by its move."""
        held = degree.join(labels, "node")
        totals = held.groupBy("community").agg(F.sum("k").alias("total"))
        near = others.join(labels.toDF("partner", "to"), "partner").groupBy("node", "to").agg(F.sum("weight").alias("w"))
        own = held.select("node", F.col("community").alias("to"), F.lit(0.0).alias("w"))  # a node may stay without a link
        options = near.unionByName(own).groupBy("node", "to").agg(F.sum("w").alias("w")).join(held, "node").join(totals.toDF("to", "total"), "to")
        gain = F.col("w") - F.col("k") * (F.col("total") - F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0.0)) / all_weight
        best = options.groupBy("node", "community").agg(
            F.max_by("to", F.struct(F.round(gain, 9), -F.col("to"))).alias("best"), F.max(F.round(gain, 9)).alias("gain"),
            F.max(F.when(F.col("to") == F.col("community"), F.round(gain, 9))).alias("stay"), F.max(F.when(F.col("to") == F.col("community"), F.col("w"))).alias("inside"), F.first("k").alias("k"),
        )
        moves = cut(best)
        by_community = moves.groupBy("community").agg(F.sum("k").alias("t"), F.sum("inside").alias("inside"), F.max(F.when(wants, F.struct(F.col("gain") - F.col("stay"), -F.col("node")))).alias("m"))
        row = by_community.agg(F.sum("inside"), F.sum(F.col("t") * F.col("t")), F.max("m")).first()
        return moves, (row[0] + loops) / all_weight - row[1] / all_weight**2, None if row[2] is None else -row[2][1]

    now, value, first = state(degree.select("node", F.col("node").alias("community")))
    turn, one_in, any_moved = 0, 2, False
    while first is not None:
        # where many at once do not help, the node that gains most alone does
        picked = wants & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(one_in)) == 0 if one_in <= 16 else F.col("node") == F.lit(first))
        turn += 1
        new, better, next_first = state(now.select("node", F.when(picked, F.col("best")).otherwise(F.col("community")).alias("community")))
        slow = better <= value + 1e-4
        if better > value + 1e-7:
            now, value, first, any_moved = new, better, next_first, True
        if one_in > 16 or slow and one_in == 16 and any_moved:  # the next level moves whole communities
            break
        one_in *= 2 if slow else 1
    return now.select("node", "community") if any_moved else None


def described(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, size, density, label) of members (node, community, size, name, type): the label names three persons, else three members."""
    inside = edges.join(members.select(F.col("node").alias("a"), "community"), "a").join(members.select(F.col("node").alias("b"), F.col("community").alias("other")), "b").filter("community = other")
    links = inside.groupBy("community").agg(F.count("*").alias("links"))
    order = F.array_sort(F.collect_list(F.struct((F.col("type") != "person").alias("after"), "node", "name")))
    first = members.withColumn("rank", F.expr("row_number() OVER (PARTITION BY community, type = 'person' ORDER BY node)")).filter("rank <= 3")
    named = first.groupBy("community", "size").agg(order.alias("m"), F.expr("count_if(type = 'person')").alias("persons"))
    label = F.expr("array_join(transform(slice(m, 1, IF(persons > 0, least(persons, 3L), 3L)), x -> x.name), ' / ')")
    density = F.when(F.col("size") > 1, 2 * F.coalesce("links", F.lit(0)) / (F.col("size") * (F.col("size") - 1))).otherwise(0.0)
    return named.join(links, "community", "left").select("community", "size", density.alias("density"), label.alias("label"))


def shared_documents(members: DataFrame, mentions: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """(community, document_id, title, category, members, rank): the ``k`` documents that name most members of each community, two at least."""
    from quaestor.operators.pairs import top_per_group

    held = mentions.join(members.select(F.col("node").alias("entity_id"), "community"), "entity_id").groupBy("community", "document_id").agg(F.countDistinct("entity_id").alias("members")).filter("members >= 2")
    top = top_per_group(held, ["community"], [F.col("members").desc(), F.col("document_id")], k)
    return top.join(docs.select(F.col("id").alias("document_id"), "title", "category"), "document_id", "left").select("community", "document_id", "title", "category", "members", "rank")


def shortest_path(edges: DataFrame, source, target) -> tuple[list, float] | None:
    """(nodes, total weight) of the path with the least sum of 1 / weight; None if there is none."""
    if source == target:
        return [source], 0.0
    ends = cut(both_ends(edges, "a", "b").withColumn("cost", 1.0 / F.col("weight")))
    kind = ends.schema["node"].dataType.simpleString()
    best = ends.sparkSession.createDataFrame([(source, 0.0, 0.0, [source])], f"node {kind}, cost double, weight double, path array<{kind}>")
    front = best
    while True:
        step = front.withColumnRenamed("cost", "so_far").withColumnRenamed("weight", "total").join(ends, "node")
        step = step.select(F.col("partner").alias("node"), (F.col("so_far") + F.col("cost")).alias("cost"), (F.col("total") + F.col("weight")).alias("weight"), F.concat("path", F.array("partner")).alias("path"))
        step = step.groupBy("node").agg(F.min(F.struct("cost", "path", "weight")).alias("m")).select("node", "m.cost", "m.weight", "m.path")
        reached = best.filter(F.col("node") == F.lit(target)).select(F.max("cost").alias("bound"))  # null before the target is reached
        old = best.select("node", F.col("cost").alias("old"))
        front = cut(step.join(old, "node", "left").crossJoin(reached).filter("(old IS NULL OR cost < old - 1e-12) AND (bound IS NULL OR cost < bound)").drop("old", "bound"))
        if not front.head(1):
            break
        best = cut(best.join(front.select("node"), "node", "left_anti").unionByName(front))
    row = best.filter(F.col("node") == F.lit(target)).first()
    return (list(row.path), row.weight) if row else None


def neighbours(edges: DataFrame, node, hops: int = 1, least_weight: int = 1) -> DataFrame:
    """(node, hops) within ``hops`` steps over edges of at least ``least_weight``."""
    ends = both_ends(edges.filter(F.col("weight") >= least_weight), "a", "b").select("node", "partner")
    kind = ends.schema["node"].dataType.simpleString()
    found = edges.sparkSession.createDataFrame([(node, 0)], f"node {kind}, hops int")
    front = found
    for k in range(1, hops + 1):
        front = front.join(ends, "node").select(F.col("partner").alias("node")).distinct().join(found, "node", "left_anti").withColumn("hops", F.lit(k))
        found = cut(found.unionByName(front))
        front = found.filter(F.col("hops") == k).select("node", "hops")
    return found.filter("hops > 0")


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (one column)."""
    n = nodes.toDF("n")
    return edges.join(n, F.col("a") == F.col("n"), "left_semi").join(n, F.col("b") == F.col("n"), "left_semi")
