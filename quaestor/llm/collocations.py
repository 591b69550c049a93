"""Collocations of two to five words by hierarchical naming of pairs.

Texts become blocks: one language's words in order, as numbers of a table of their own, with marks
between pieces.  A block's distinct words are counted over all blocks, and frequent ones get a name.
From then on a run of k words is the pair of the names of its first and its last k - 1 words:
each block sends its distinct pairs, a shuffle by pair adds them up, and frequent pairs get a name,
which is joined back to the blocks that hold them: up to ``few`` names by a broadcast of them all, more
by a shuffle, which gives the same.  What is not frequent ends a stretch, as nothing frequent contains it.
A name's row keeps the names of its two parts.  These parent pointers give a run's words, the counts
of the parts of every cut, and what it subsumes: a run's count is at most that of its parts, so
whatever contains it as often has, among the runs that are one word longer, one that contains it as
often.

A common word or pair is one row a block in the shuffle.  A block holds at most ``block_words``
words unless one piece is longer; it is all that a task holds.

Null texts are empty, a null language is ``und``; rows that share an id all count; an empty
table gives an empty result.  Counts, scores and products are exact integers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settled, small_batches, written
from .words import release, slices

#: A word holds none of these, so one of them marks the end of a piece.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(_ENDS))
_BLOCK = "block long, lang string, codes binary, words array<binary>, counts array<long>"
#: Bits of a name that number what a block holds, and of a block's number that count the blocks of a task.
_BITS, _TASK_BITS = 27, 14


class _Codes(dict):
    """word -> its number, from 1; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class _Block:
    def __init__(self):
        self.codes, self.parts, self.size = _Codes({b".": 0}), [], 0

    def add(self, text: bytes) -> None:
        words = text.translate(_TABLE).replace(b".", b" . ").split()
        words.append(b".")
        self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        codes = _squeezed(np.concatenate(self.parts))
        words = list(self.codes)[1:]
        counts = np.bincount(codes, minlength=len(words) + 1)[1:]
        columns = [pa.array([number], pa.int64()), pa.array([lang]), pa.array([_packed(codes)], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))], names=["block", "lang", "codes", "words", "counts"])


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Without zeros that follow zeros."""
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])] if len(codes) else codes


def _packed(codes: np.ndarray) -> bytes:
    """Numbers in two bytes each where they fit, else in four; the first byte tells."""
    wide = bool(len(codes)) and int(codes.max()) >= 1 << 16
    return bytes([4 if wide else 2]) + codes.astype("<u4" if wide else "<u2").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4" if packed[0] == 4 else "<u2", offset=1).astype(np.int64)


def _longs(packed: pa.Scalar) -> np.ndarray:
    held = packed.as_py()
    return np.frombuffer(held, np.int64) if held else np.empty(0, np.int64)


def _texts(body: bytes, most: int) -> Iterator[bytes]:
    """A text in stretches of about ``most`` bytes that end where a piece does."""
    begin = 0
    while len(body) - begin > most:
        end = begin + most
        while end < len(body) and body[end] not in _ENDS:
            end += 1
        yield body[begin:end]
        begin = end
    yield body[begin:]


def _blocks(docs: DataFrame, block_words: int, text: str, lang: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        open_blocks: dict[str, _Block] = defaultdict(_Block)

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            block = open_blocks.pop(lang)
            if made >= 1 << _TASK_BITS or len(block.codes) >= 1 << _BITS or task >= 1 << (63 - _BITS - _TASK_BITS):
                raise OverflowError("names of 63 bits do not suffice: read the table in tasks of another size")
            return block.row((task << _TASK_BITS) + made, lang)

        for batch in batches:
            for part in slices(batch, "body"):
                for lang, body in zip(part.column("lang").to_pylist(), part.column("body").to_pylist(), strict=True):
                    for stretch in _texts(body, 4 * block_words):
                        open_blocks[lang].add(stretch)
                        if open_blocks[lang].size >= block_words:
                            yield closed(lang)
                while sum(b.size for b in open_blocks.values()) > 2 * block_words:  # many languages in one task
                    yield closed(max(open_blocks, key=lambda k: open_blocks[k].size))
        for lang in list(open_blocks):
            yield closed(lang)
        release()

    return rows.mapInArrow(run, _BLOCK)


def _pairs(blocks: DataFrame, short: bool) -> DataFrame:
    """The distinct pairs of neighbouring names of each block: place (block and number), left and right name, n.

    Two ``short`` names, of 31 bits, are one number ``lr``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, names = batch.column("block")[row].as_py(), _longs(batch.column("names")[row])
                keys, counts = np.unique(_keys(_unpacked(batch.column("codes")[row].as_py()), len(names))[1], return_counts=True)
                left, right = np.divmod(keys, max(1, len(names)))
                places = (np.int64(block) << _BITS) + np.arange(len(keys))
                for at in range(0, len(keys), 1 << 16):
                    cut = slice(at, at + (1 << 16))
                    both = [(names[left] << 32) | names[right]] if short else [names[left], names[right]]
                    yield pa.RecordBatch.from_arrays([pa.array(c[cut]) for c in (places, *both, counts)], names=["place", *(["lr"] if short else ["l", "r"]), "n"])
        release()

    return blocks.select("block", "codes", "names").mapInArrow(run, "place long, " + ("lr long" if short else "l long, r long") + ", n long")


def _keys(codes: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray]:
    """Where neighbouring codes are both frequent, and the number of each such pair (codes count from 1)."""
    at = np.flatnonzero((codes[:-1] != 0) & (codes[1:] != 0))
    return at, (codes[at] - 1) * max(1, names) + codes[at + 1] - 1


def _named(counted: DataFrame, key: list[str], least: int, label: str) -> tuple[DataFrame, int]:
    """((id, key, f) of frequent keys, their number): a written table, whose rows are then numbered without gaps, a task's after another's."""
    found = counted.groupBy(*key).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    found = written(found.withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", 33)
    parts = sorted((r.part, r.n) for r in found.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a task
    first = np.cumsum([0, *(n for _, n in parts)]).tolist()
    before = found.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(parts, first, strict=False)], "part long, before long")
    placed = found.withColumn("part", part).join(F.broadcast(before), "part")
    return placed.withColumn("id", F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before")).select(*key, "f", "id"), first[-1]


def _from_words(codes: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Codes of words (from 1) as codes of names, 0 where a word has none."""
    return _squeezed(np.concatenate([[0], new])[codes])


def _from_pairs(codes: np.ndarray, at: np.ndarray, places: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.int64)
    out[at] = new[places]
    return _squeezed(out)


def _block_row(block: int, codes: np.ndarray, names: np.ndarray) -> dict:
    return {"block": pa.array([block], pa.int64()), "codes": pa.array([_packed(codes)], pa.binary()), "names": pa.array([names.astype(np.int64).tobytes()], pa.binary())}


_NAMED_BLOCK = "block long, codes binary, names binary"


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each entry, 0 where its id is negative; the ids that have a code, from 1)."""
    has = ids >= 0
    return np.where(has, np.cumsum(has), 0), ids[has]


def _renamed_here(blocks: DataFrame, named: DataFrame, single: bool) -> DataFrame:
    """Blocks over the names one level up, by a broadcast of the names."""
    context = blocks.sparkSession.sparkContext
    if single:
        table = named.select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow().to_pydict()
        by_lang: dict[str, dict[bytes, int]] = defaultdict(dict)
        for lang, word, k in zip(table["lang"], table["word"], table["id"], strict=True):
            by_lang[lang][word] = k
        shared = context.broadcast(dict(by_lang))  # at most ``few`` names, which the caller has counted
    else:
        table = named.select("l", "r", "id").orderBy("l", "r").toArrow()
        left, right, ids = (table[c].to_numpy() for c in ("l", "r", "id"))
        shared = context.broadcast((left, right, ids))  # the same

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = shared.value.get(batch.column("lang")[row].as_py(), {})
                held = batch.column("words")[row].as_py()
                new, names = _numbered(np.fromiter((own.get(w, -1) for w in held), np.int64, len(held)))
                yield pa.RecordBatch.from_pydict(_block_row(batch.column("block")[row].as_py(), _from_words(_unpacked(batch.column("codes")[row].as_py()), new), names))
        release()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, ids = shared.value
        lefts, rights = np.unique(left), np.unique(right)
        keys = np.searchsorted(lefts, left) * max(1, len(rights)) + np.searchsorted(rights, right)  # ascending, as the table is
        for batch in batches:
            for row in range(batch.num_rows):
                names = _longs(batch.column("names")[row])
                codes = _unpacked(batch.column("codes")[row].as_py())
                at, own = _keys(codes, len(names))
                distinct, places = np.unique(own, return_inverse=True)
                l_names, r_names = (names[x] for x in np.divmod(distinct, max(1, len(names))))
                found = np.full(len(distinct), -1, np.int64)
                if len(keys) and len(distinct):
                    li, ri = (np.minimum(np.searchsorted(t, x), len(t) - 1) for t, x in ((lefts, l_names), (rights, r_names)))
                    wanted = li * len(rights) + ri
                    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    same = (lefts[li] == l_names) & (rights[ri] == r_names) & (keys[k] == wanted)
                    found[same] = ids[k[same]]
                new, kept = _numbered(found)
                yield pa.RecordBatch.from_pydict(_block_row(batch.column("block")[row].as_py(), _from_pairs(codes, at, places, new), kept))
        release()

    if single:
        return blocks.select("block", "lang", "codes", "words").mapInArrow(words, _NAMED_BLOCK)
    return blocks.select("block", "codes", "names").mapInArrow(pairs, _NAMED_BLOCK)


def _renamed_there(blocks: DataFrame, found: DataFrame, single: bool) -> DataFrame:
    """The same by a shuffle; ``found`` holds (place, id) of what has a name."""

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        if not block.num_rows or not found.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "codes": pa.array([], pa.binary()), "names": pa.array([], pa.binary())})
        codes = _unpacked(block["codes"][0].as_py())
        own, given = found["place"].to_numpy() & ((1 << _BITS) - 1), found["id"].to_numpy()
        if single:
            ids = np.full(int(max(codes.max(), own.max())), -1, np.int64)
            ids[own - 1] = given
            new, names = _numbered(ids)
            codes = _from_words(codes, new)
        else:
            at, keys = _keys(codes, len(_longs(block["names"][0])))
            distinct, places = np.unique(keys, return_inverse=True)
            ids = np.full(len(distinct), -1, np.int64)
            ids[own] = given
            new, names = _numbered(ids)
            codes = _from_pairs(codes, at, places, new)
        return pa.table(_block_row(block["block"][0].as_py(), codes, names))

    by_block = found.select(F.shiftright("place", _BITS).alias("block"), "place", "id")
    both = blocks.select("block", "codes", *([] if single else ["names"])).groupBy("block").cogroup(by_block.groupBy("block"))
    return both.applyInArrow(run, _NAMED_BLOCK)


def grams(docs: DataFrame, *, longest: int = 5, least: int = 100, block_words: int = 2_500_000, few: int = 400_000, bits: int = 31, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(runs of one to ``longest`` words with at least ``least`` occurrences, word occurrences of each lang), written tables.

    A run's row: id, size, lang, phrase, last (its last word), f, l and r (ids of its first and last size - 1 words; null for
    words), heads and tails (counts of its first 1, 2, ... words and of what follows them), subsumed.
    """
    small_batches(docs.sparkSession)
    blocks = written(_blocks(docs, block_words, text, lang), "word-blocks", maxRecordsPerFile=8, compression="zstd")
    totals = written(blocks.select("lang", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select(
        (F.shiftleft("block", _BITS) + F.col("pos") + 1).alias("place"), "lang", F.col("col.words").cast("string").alias("word"), F.col("col.counts").alias("n")
    )
    counted, key = words, ["lang", "word"]
    named, names = _named(words.drop("place"), key, least, "named-words")
    none = F.array().cast("array<long>")
    word = F.col("word")
    runs = written(named.select("id", F.lit(1).alias("size"), "lang", word.alias("phrase"), word.alias("last"), "f", F.lit(None).cast("long").alias("l"), F.lit(None).cast("long").alias("r"), none.alias("heads"), none.alias("tails")), "runs")
    levels = [runs]
    for size in range(2, longest + 1):
        if names <= few:
            blocks = _renamed_here(blocks, named, size == 2)
        else:
            blocks = _renamed_there(blocks, counted.join(named, key).select("place", "id"), size == 2)
        blocks = written(blocks, "name-blocks", maxRecordsPerFile=8, compression="zstd")
        short = names < 1 << bits
        counted, key = _pairs(blocks, short), ["lr"] if short else ["l", "r"]
        named, names = _named(counted.drop("place"), key, least, "named-pairs")
        if short:
            named = named.withColumns({"l": F.shiftright("lr", 32), "r": F.col("lr").bitwiseAND((1 << 32) - 1)})
        parts = runs.select("id", "lang", "phrase", "last", "f", "heads", "tails")
        left = parts.select(F.col("id").alias("l"), "lang", F.col("phrase").alias("lp"), F.col("f").alias("lf"), "heads")
        right = parts.select(F.col("id").alias("r"), F.col("last"), F.col("f").alias("rf"), "tails")
        made = named.drop("lr").join(left, "l").join(right, "r")
        runs = written(
            made.select("id", F.lit(size).alias("size"), "lang", F.concat_ws(" ", "lp", "last").alias("phrase"), "last", "f", "l", "r", F.concat("heads", F.array("lf")).alias("heads"), F.concat(F.array("rf"), "tails").alias("tails")), "runs"
        )
        levels.append(runs)
    out = []
    for k, level in enumerate(levels):
        if k + 1 < len(levels):
            above = levels[k + 1].select("l", "r", "f")
            as_often = above.select(F.col("l").alias("id"), "f").union(above.select(F.col("r").alias("id"), "f")).distinct()
            level = level.join(as_often.withColumn("subsumed", F.lit(True)), ["id", "f"], "left").withColumn("subsumed", F.coalesce("subsumed", F.lit(False)))
        else:
            level = level.withColumn("subsumed", F.lit(False))
        out.append(level)
    every = out[0]
    for level in out[1:]:
        every = every.unionByName(level)
    return every, totals


def scored(runs: DataFrame, totals: DataFrame, few: int = 10_000) -> DataFrame:
    """Candidates (two words or more, not subsumed): lang, phrase, a, and of the lowest-scoring cut l, r, n, score.

    ``totals`` is broadcast up to ``few`` languages, and joined by a shuffle beyond that.
    """
    small = totals.limit(few + 1).count() <= few
    wide = "decimal(19,0)"
    cut = (
        "array_min(transform(arrays_zip(heads, tails), (x, k) -> struct("
        f"cast(cast(1000 * cast(f AS {wide}) AS decimal(23,0)) * cast(n AS decimal(15,0)) div (cast(x.heads AS {wide}) * cast(x.tails AS {wide})) AS long) AS score, k, x.heads AS l, x.tails AS r)))"
    )
    found = runs.filter("size > 1 AND NOT subsumed").join(F.broadcast(totals) if small else totals, "lang")
    return found.withColumn("cut", F.expr(cut)).select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def best(found: DataFrame, most: int, shares: int = 64) -> DataFrame:
    """Each lang's first ``most`` by score, a, phrase, with their rank: first within shares of a lang, then of what is left."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    first = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= most).drop("share", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, *, least: int = 100, most: int = 2000, longest: int = 5, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best ``most`` phrases; a written table, whose steps' tables are deleted."""

    def build() -> DataFrame:
        return best(scored(*grams(docs, longest=longest, least=least, **options)), most)

    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return settled(docs.sparkSession, "collocations", build).select(*columns)
