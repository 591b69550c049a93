"""MinHash near-duplicates with odd sketches, confirmed on full shingle sets.

1. A text's set of word shingles gives a fingerprint, 128 MinHash samples filed in 32 bands of
   4, and an odd sketch: the samples folded into 512 parity bits, so that two sketches' XOR
   population count estimates the number of differing samples, precisely where few differ.
   At similarity 0.8 all bands miss with a chance of 5e-8.
2. Equal sets collapse into one node, so copies cost one row each from here on.
3. Nodes that share a band key are candidates.  Small buckets give their pairs, filtered by the
   odd sketches (at similarity 0.8 the estimate falls below 0.55 with a chance under 1e-8);
   larger ones link every member with one centre, unfiltered, so that no bucket is capped.
   The components of these candidates hold every pair that can be linked.
4. Each component's texts meet in tasks of at most ``task_nodes`` nodes.  A task compares all
   pairs of different components so far by sketch and confirms them on full shingle sets.
5. Components larger than a task are dealt to tasks at random, twice over, so that nearly all of
   a group of near copies grows together at once.  What pairs of different parts can still be
   linked share a shingle early in an order by rarity (prefix filter): of a pair the smaller set
   has one among its first n - ceil(1.6 n / 1.8) + 1, the larger among its first
   n - ceil(0.8 n) + 1.  Texts that only have a template in common are rare where they differ and
   share no such shingle, so a family of them costs its size, not its square.  Sketches thin the
   pairs out, and only texts of pairs that pass meet, those closest to each other part first.
   The order comes from about ``sampled`` of a component's texts; any order gives the same links.
6. Where at most one task's worth of nodes lie outside a component's largest part, or the prefixes
   give more than ``dense`` pairs a text, every node outside it is compared with all the others
   instead, in blocks.  Pairs within one part need no comparison, so the links found have exactly
   the components that all pairs would give.

Empty cases: a null text or one without words has an empty set, which is linked with nothing.
Fewer words than ``width`` make one shingle of all of them.  Rows that share a doc_id are
documents of their own, compared by their texts.  A null doc_id never becomes a component's
smallest id unless all are null.  An empty table gives an empty result.  Only the two named
columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import small_batches, written
from .words import RADIX, WordHashes, mixed, shingles, slices

BANDS, ROWS, BITS = 32, 4, 512
_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_INDEX = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * RADIX)


def fingerprint(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def samples(own: np.ndarray) -> np.ndarray:
    """The 128 MinHash samples of a non-empty set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), 512):
        block = own[start : start + 512, None] * _A
        block += _B
        np.minimum(low, block.min(0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows, key = low.reshape(BANDS, ROWS), _INDEX[:BANDS].copy()
    for k in range(ROWS):
        key = mixed(key * RADIX + rows[:, k])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """512 bits as 8 integers: bit k tells whether an odd number of samples falls on k."""
    bits = np.bincount((mixed(low * RADIX + _INDEX) >> np.uint64(55)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def least_similar(distance, samples_: int = BANDS * ROWS):
    """Similarity estimated from the XOR population count of two odd sketches."""
    ratio = np.clip(1 - 2 * np.asarray(distance, float) / BITS, 1e-9, 1)
    return 1 - np.log(ratio) / np.log1p(-2 / BITS) / (2 * samples_)


#: Largest distance of two sketches that is looked into: an estimate of 0.55.
FURTHEST = int(np.floor(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * BANDS * ROWS * 0.45))))


def _signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body")).withColumn("text_hash", F.xxhash64("body"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for part in slices(batch, "body"):
                n, fps, bands, sketches = [], [], [], []
                for body in part.column("body").to_pylist():
                    own = shingles(cache.of((body or b"").lower().split()), width)
                    n.append(len(own))
                    low = samples(own) if len(own) else None
                    fps.append(fingerprint(own) if len(own) else None)
                    bands.append(None if low is None else band_keys(low))
                    sketches.append(None if low is None else odd_sketch(low))
                arrays = [part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "n_shingles", "fp", "bands", "sketch"])

    return rows.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, fp binary, bands array<long>, sketch array<long>")


def _candidates(nodes: DataFrame, small: int) -> DataFrame:
    """Links (a, b) between nodes whose components hold all pairs that share a band key and may be similar."""
    filed = nodes.select("fp", F.explode("bands").alias("key"))
    counts = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(filed.join(counts, "key"), "buckets")
    few = shared.filter(F.col("n") <= small)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter("a > b").select("a", "b").distinct()
    sketches = nodes.select("fp", "sketch")
    near = (
        pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
        .filter(F.expr(f"aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {FURTHEST}"))
        .select("a", "b")
    )
    many = shared.filter(F.col("n") > small).withColumn("shares", F.expr("n div 1024 + 1"))  # a large bucket meets its centre in several tasks
    centres = many.groupBy("key", "shares").agg(F.min(F.struct(F.xxhash64("key", "fp"), "fp")).alias("c"))
    centres = centres.select("key", F.col("c.fp").alias("b"), F.explode(F.expr("sequence(0L, shares - 1)")).alias("share"))
    stars = many.withColumn("share", F.pmod(F.xxhash64("fp"), "shares")).join(centres, ["key", "share"]).select(F.col("fp").alias("a"), "b").filter("a != b")
    return near.unionAll(stars)


def _confirm(percent: int, width: int):
    """For a task's nodes: links that confirm pairs of different parts; of strangers, only with one of them."""

    def confirm(table: pa.Table) -> pa.Table:
        fps, parts = table.column("fp").to_pylist(), table.column("part").to_pylist()
        strange = np.array(table.column("stranger").to_pylist(), bool)
        cache, sets, seen, kept = WordHashes(), [], set(), []
        for k, body in enumerate(table.column("body")):
            own = shingles(cache.of((body.as_py() or b"").lower().split()), width)
            if fps[k] not in seen and len(own) and fingerprint(own) == fps[k]:
                seen.add(fps[k])
                kept.append(k)
                sets.append(own)
        parent = list(range(len(kept)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        first: dict[bytes, int] = {}
        for x, k in enumerate(kept):
            parent[x] = find(first.setdefault(parts[k], x))
        flat = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)[kept]
        sizes, strange = np.array([len(s) for s in sets], np.int64), strange[kept]
        anyone = not strange.any()
        a, b = [], []
        for x in range(len(kept) - 1):
            rest = np.arange(x + 1, len(kept))
            if not anyone and not strange[x]:
                rest = rest[strange[rest]]
            low, high = np.minimum(sizes[rest], sizes[x]), np.maximum(sizes[rest], sizes[x])
            rest = rest[100 * low >= percent * high]
            distance = np.bitwise_count(flat[rest] ^ flat[x]).sum(1)
            near = np.argsort(distance, kind="stable")
            for y in rest[near[: int((distance <= FURTHEST).sum())]].tolist():
                if (p := find(x)) != (q := find(y)):
                    one, other = (sets[x], sets[y]) if sizes[x] < sizes[y] else (sets[y], sets[x])
                    at = np.searchsorted(other, one)
                    at[at == len(other)] = 0
                    both = int((other[at] == one).sum())
                    if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                        parent[max(p, q)] = min(p, q)
                        a.append(fps[kept[x]])
                        b.append(fps[kept[y]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return confirm


def _parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the component, by ``links``, of each."""
    return nodes.join(components(links).toDF("fp", "joined"), "fp", "left").withColumn("part", F.coalesce("joined", "fp")).drop("joined")


def _orders(texts: DataFrame, width: int, sampled: int) -> DataFrame:
    """(cc, common): shingles that are frequent among about ``sampled`` texts of a component, the most frequent last."""

    def frequent(table: pa.Table) -> pa.Table:
        cache = WordHashes()
        sets = [shingles(cache.of((b.as_py() or b"").lower().split()), width) for b in table.column("body")]
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        keep = n >= max(2, 0.05 * len(sets))
        found, n = found[keep], n[keep]
        return pa.table({"cc": table.column("cc").slice(0, 1), "common": pa.array([found[np.lexsort((found, n))][-4096:].tobytes()], pa.binary())})

    some = texts.filter(F.pmod(F.xxhash64("fp", F.lit(9)), F.ceil(F.col("size") / sampled)) == 0)
    return some.select("cc", "body").groupBy("cc").applyInArrow(frequent, "cc binary, common binary")


def _prefixes(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """(cc, size, key, fp, n, part, stranger, early): the shingles, rarest first, one of which any two similar sets share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for part in slices(batch, "body"):
                keys, sizes, early = [], [], []
                for body, common in zip(part.column("body").to_pylist(), part.column("common").to_pylist(), strict=True):
                    own = shingles(cache.of((body or b"").lower().split()), width)
                    frequent = np.frombuffer(common or b"", np.uint64)
                    rank = np.full(len(own), -1)
                    if len(frequent):
                        by_hash = np.argsort(frequent)
                        at = np.minimum(np.searchsorted(frequent[by_hash], own), len(frequent) - 1)
                        rank = np.where(frequent[by_hash][at] == own, by_hash[at], -1)
                    n = len(own)
                    first = own[np.lexsort((own, rank))][: n + 1 + -percent * n // 100]
                    keys.append(first.view(np.int64))
                    sizes.append(n)
                    early.append(np.arange(len(first)) < n + 1 + -2 * percent * n // (100 + percent))
                counts = [len(k) for k in keys]
                take = pa.array(np.repeat(np.arange(len(counts)), counts))
                names = ["cc", "size", "fp", "part", "stranger"]
                arrays = [part.column(c).take(take) for c in names] + [pa.array(np.repeat(np.array(sizes, np.int64), counts)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(early))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n", "shingle", "early"])

    found = rows.select("cc", "size", "fp", "part", "stranger", "body", "common").mapInArrow(cut, "cc binary, size long, fp binary, part binary, stranger boolean, n long, shingle long, early boolean")
    return found.withColumn("key", F.xxhash64("cc", "shingle")).drop("shingle")


def _both(percent: int, width: int):
    """Of pairs with their texts, those that are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for part in slices(batch, "body_a"):
                keep = []
                for one, other in zip(part.column("body_a").to_pylist(), part.column("body_b").to_pylist(), strict=True):
                    x, y = (shingles(cache.of((t or b"").lower().split()), width) for t in (one, other))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return check


def _by_prefix(prefixes: DataFrame, texts: DataFrame, parts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links between different parts, at least one for any two parts that have one, from pairs that share a prefix shingle."""
    side = lambda c: F.struct("fp", "n", "part", "stranger").alias(c)
    early, every = prefixes.filter("early").select("key", side("x")), prefixes.select("key", side("y"))
    fits = f"x.part != y.part AND x.n <= y.n AND 100 * x.n >= {percent} * y.n"
    met = early.filter("x.stranger").join(every, "key").filter(fits).unionAll(early.filter("NOT x.stranger").join(every.filter("y.stranger"), "key").filter(fits))
    pairs = met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    sketches = texts.select("fp", "sketch").distinct()
    near = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
    distance = F.expr("aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    left = written(near.select("a", "b", distance.alias("distance")).filter(F.col("distance") <= FURTHEST), "near")
    bodies = texts.select("fp", "body")
    members, links = parts.select("fp", "part"), None
    for turn in range(4):
        members = written(members, "members")
        named = left.join(members.toDF("a", "part_a"), "a").join(members.toDF("b", "part_b"), "b").filter("part_a != part_b")
        if not named.head(1):
            break
        named = written(named, "open")
        # in the last turn all that is left, before that the closest pair of a node and another part
        chosen = named.select("a", "b") if turn == 3 else named.groupBy("a", "part_b").agg(F.min(F.struct("distance", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        chosen = written(chosen, "chosen")
        met = chosen.join(bodies.toDF("a", "body_a"), "a").join(bodies.toDF("b", "body_b"), "b")
        confirmed = written(met.mapInArrow(_both(percent, width), "a binary, b binary"), "confirmed")
        links = confirmed if links is None else links.unionAll(confirmed)
        left = named.join(chosen, ["a", "b"], "left_anti").select("a", "b", "distance")
        renamed = components(confirmed.join(members.toDF("a", "part_a"), "a").join(members.toDF("b", "part_b"), "b").select("part_a", "part_b")).toDF("part", "joined")
        members = members.join(renamed, "part", "left").select("fp", F.coalesce("joined", "part").alias("part"))
    return links


def _in_blocks(rows: DataFrame, task, task_nodes: int) -> DataFrame:
    """Links between each stranger and all others of its component, in blocks."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(3)), F.ceil(F.col("size") / task_nodes)))
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / task_nodes)).withColumn("strange_blocks", F.ceil(F.col("outside") / task_nodes))
    others = rows.filter("NOT stranger").withColumn("strange", F.explode(F.expr("sequence(0L, strange_blocks - 1)")))
    strangers = rows.filter("stranger").withColumn("strange", F.pmod(F.xxhash64("fp", F.lit(4)), "strange_blocks"))
    against = strangers.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    met = others.select("cc", "block", "strange", "fp", "part", "stranger", "sketch", "body").unionAll(against.select("cc", "block", "strange", "fp", "part", "stranger", "sketch", "body"))
    links = written(task(met, "cc", "block", "strange"), "confirmed")
    # two strangers of different strange blocks
    pairs = strangers.filter("strange_blocks > 1").withColumn("other", F.explode(F.expr("sequence(0L, strange_blocks - 1)"))).withColumn("low", F.least("strange", "other")).withColumn("high", F.greatest("strange", "other")).filter("low < high")
    return links.unionAll(written(task(pairs, "cc", "low", "high"), "confirmed"))


def _links(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, width: int, percent: int, small: int, task_nodes: int, sampled: int, dense: int) -> DataFrame:
    """Confirmed links (a, b) that span the components of all nodes."""
    reach = written(components(_candidates(nodes, small)).toDF("fp", "cc"), "reach")
    sizes = reach.groupBy("cc").agg(F.count("*").alias("size"))
    wanted = nodes.join(reach.join(sizes, "cc"), "fp").select("fp", "cc", "size", "sketch", "label", "text_hash")
    bodies = docs.select(F.col(doc_id).cast("long").alias("own_id"), F.col(text).cast("binary").alias("body")).withColumn("text_hash", F.xxhash64("body"))
    texts = bodies.join(wanted, [bodies["text_hash"] == wanted["text_hash"], F.expr("own_id <=> label")]).select("fp", "cc", "size", "sketch", "body")
    texts = written(texts, "texts")
    confirm = _confirm(percent, width)

    def task(rows: DataFrame, *keys) -> DataFrame:
        return rows.select(*keys, "fp", "part", "stranger", "sketch", "body").groupBy(*keys).applyInArrow(confirm, "a binary, b binary")

    def dealt(rows: DataFrame, turn: int) -> DataFrame:
        return rows.withColumn("turn", F.lit(turn)).withColumn("block", F.pmod(F.xxhash64("fp", F.lit(turn)), F.ceil(F.col("size") / task_nodes)))

    fresh = texts.withColumn("part", F.col("fp")).withColumn("stranger", F.lit(False))
    large = texts.filter(F.col("size") > task_nodes)
    again = dealt(fresh.filter(F.col("size") > task_nodes), 1)
    links = written(task(dealt(fresh, 0).unionAll(again), "cc", "turn", "block"), "confirmed")
    if not large.select("fp").head(1):
        return links
    members = reach.join(sizes.filter(F.col("size") > task_nodes), "cc").select("fp", "cc", "size")
    parts = written(_parts(members, links), "parts")
    by_size = parts.groupBy("cc", "part").agg(F.count("*").alias("n"))
    main = by_size.groupBy("cc").agg(F.max(F.struct("n", "part")).alias("m"), F.sum("n").alias("all")).select("cc", F.col("m.part").alias("main"), (F.col("all") - F.col("m.n")).alias("outside"))
    main = written(main.filter("outside > 0"), "main")
    ccs = main.count()
    if not ccs:
        return links
    bounded = lambda table: F.broadcast(table) if ccs < 10_000 else table
    rows = large.join(parts.select("fp", "part"), "fp").join(bounded(main), "cc").withColumn("stranger", F.expr("part != main"))
    few = F.col("outside") <= task_nodes
    if main.filter(few).head(1):
        links = links.unionAll(_in_blocks(rows.filter(few), task, task_nodes))
    if main.filter(~few).head(1):
        many = large.join(bounded(main.filter(~few).select("cc")), "cc").dropDuplicates(["fp"])  # rows of one doc_id and text are one node
        orders = written(_orders(many, width, sampled), "orders")
        few_orders = lambda table: F.broadcast(table) if ccs < 1_000 else table  # noqa: E731  (32 KB each at most)
        own = rows.filter(~few).dropDuplicates(["fp"])
        prefixes = written(_prefixes(own.join(few_orders(orders), "cc", "left"), percent, width), "prefixes")
        lists = prefixes.groupBy("key").agg(
            F.first("cc").alias("cc"), F.first("size").alias("size"), F.expr("count_if(early AND stranger)").alias("strange"), F.expr("count_if(early AND NOT stranger)").alias("known"),
            F.count("*").alias("every"), F.expr("count_if(stranger)").alias("strangers"),
        )
        crowded = lists.groupBy("cc").agg(F.sum(F.expr("strange * every + known * strangers")).alias("pairs"), F.first("size").alias("size")).filter(F.col("pairs") > dense * F.col("size")).select("cc")
        crowded = written(crowded, "crowded")
        found = _by_prefix(prefixes.join(bounded(crowded), "cc", "left_anti"), many, parts, percent, width)
        if found is not None:
            links = links.unionAll(found)
        if crowded.head(1):
            links = links.unionAll(_in_blocks(own.join(bounded(crowded), "cc", "left_semi"), task, task_nodes))
    return written(links, "confirmed")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, small: int = 16, task_nodes: int = 400,
    sampled: int = 200, dense: int = 64,
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept.

    Documents whose sets satisfy 100 * intersection >= ``percent`` * union are linked;
    ``component_id`` is the smallest doc_id reachable, ``kept`` whether it is the own one.
    """
    small_batches(docs.sparkSession)
    signed = written(_signatures(docs, doc_id, text, width), "signatures")
    nodes = written(
        signed.filter("fp IS NOT NULL").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("m"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .select("fp", F.col("m.doc_id").alias("label"), F.col("m.text_hash").alias("text_hash"), "bands", "sketch"),
        "nodes",
    )
    links = _links(docs, nodes, doc_id, text, width, percent, small, task_nodes, sampled, dense)
    labelled = _parts(nodes.select("fp", "label"), links)
    smallest = labelled.groupBy("part").agg(F.min("label").alias("component_id"))
    found = labelled.join(smallest, "part").select("fp", "component_id")
    return (
        signed.select("doc_id", "text_hash", "n_shingles", "fp").join(found, "fp", "left")
        .select("doc_id", "text_hash", "n_shingles", F.expr("IF(fp IS NULL, doc_id, component_id)").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all their columns, one of each group of near-duplicates: its smallest doc_id's first row.

    Rows without a doc_id stay, unless a row with one stands for their group.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    keys = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    hashed = docs.select(F.struct("*").alias("row")).withColumn("row_hash", F.xxhash64(F.col(f"row.`{text}`").cast("binary"))).withColumn("row_id", F.col(f"row.`{doc_id}`").cast("long"))
    once = hashed.join(keys, [hashed["row_hash"] == keys["kept_hash"], F.expr("row_id <=> kept_id")], "left_semi")
    first = F.row_number().over(Window.partitionBy("row_hash", "row_id").orderBy(F.xxhash64("row")))
    repeated = once.withColumn("place", first).filter("place = 1 OR row_id IS NULL")
    return repeated.select("row.*")
