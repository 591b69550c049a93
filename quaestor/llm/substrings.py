"""Removal of repeated passages: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

A window's hash travels to the bucket of its minimizer, the smallest hash among the shorter
word runs inside it.  Equal windows have equal minimizers and meet in one bucket, and windows
next to each other mostly share theirs, so what travels is one packed row per slice of text
and bucket: hashes, and runs of places.  A slice sends each distinct window once and settles
its own repeats itself, so a passage that a third of all documents hold costs a bucket one
entry per slice.  A bucket counts its windows by sorting and answers with the runs of places
whose windows start elsewhere too; runs of a text are merged into maximal intervals and those
words are removed.

Windows that differ may share a minimizer in great numbers: a common phrase of fewer words than
a window stands in as many surroundings as there are documents.  One text of ``planned_one_in``,
by hash, is therefore counted by bucket first, and a bucket with more than its share of distinct
windows is split by the hash of the whole window.  That plan decides where a window is counted,
never whether.

Windows are equal when 64-bit hashes and buckets are; the number of buckets follows the size
of the corpus at about ``bucket_bytes`` of text each, so a bucket sees about a million windows
and takes two different ones for equal with a chance of about 4e-8.  That is per bucket: at
100 TB about one wrong match is expected in all.  Texts are told apart by 96 bits.

Empty cases: a null text has no words and stays null; a text shorter than ``width`` keeps all.
Windows of one document repeat each other like those of others, overlapping ones included.
Rows with equal texts are repeats of each other whatever their ids.  An empty table gives an
empty result.  Other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches, written
from .words import RADIX, WordHashes, mixed, run_hashes, slices

_FRAGMENT = "bucket int, settled boolean, hashes binary, texts binary, checks binary, counts binary, starts binary, lengths binary"
_NAMES = ["bucket", "settled", "hashes", "texts", "checks", "counts", "starts", "lengths"]

#: A run's length is one byte, longer runs are parted.  Its highest bit is set where the windows also start elsewhere in
#: their own slice, which settles them.
_LONGEST, _SETTLED = 127, np.uint8(128)


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        step = min(span, width - span)
        values = np.minimum(values[: len(values) - step], values[step:])
        span += step
    return values


def _changes(*columns: np.ndarray) -> np.ndarray:
    """First places of the stretches in which no column changes."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _runs(owner: np.ndarray, place: np.ndarray, *groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of runs of consecutive places of one owner and one value of each of ``groups``."""
    first = _changes(place - np.arange(len(place)), owner, *groups)
    return first, np.diff(np.append(first, len(owner)))


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the stretches of ``data`` between ``bounds``."""
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


#: A bucket of more than so many times its fair share of windows is split.
_UNEVEN = 1.5
#: Buckets that are split at most, and partitions that buckets are dealt to at most.
_MOST_SPLIT, _MOST_TASKS = 200_000, 8192


class _Slice:
    """The windows of a slice of texts, each text once."""

    def __init__(self, part: pa.RecordBatch, cache: WordHashes, width: int, inner: int):
        hashes, least, owners, places, seen = [], [], [], [], {}
        self.texts, self.checks, twice = [], [], []
        for text, check, body in zip(*(part.column(c).to_pylist() for c in ("text_hash", "text_check", "body")), strict=True):
            if (text, check) in seen:
                if seen[text, check] >= 0:
                    twice[seen[text, check]] = True
                continue
            words = cache.of((body or b"").split())
            own = run_hashes(words, width)
            seen[text, check] = len(self.texts) if len(own) else -1
            if len(own):
                hashes.append(own)
                least.append(mixed(_sliding_minimum(run_hashes(words, inner), width - inner + 1)))
                owners.append(np.full(len(own), len(self.texts), np.int64))
                places.append(np.arange(len(own)))
                self.texts.append(text)
                self.checks.append(check)
                twice.append(False)
        self.empty = not self.texts
        if self.empty:
            return
        self.texts, self.checks = np.array(self.texts, np.int64), np.array(self.checks, np.uint32)
        self.hash, self.least, self.owner, self.place = map(np.concatenate, (hashes, least, owners, places))
        order = np.argsort(self.hash, kind="stable")
        same = self.hash[order][1:] == self.hash[order][:-1]
        self.repeated = np.array(twice)[self.owner]
        self.repeated[order[1:][same]] = True
        self.repeated[order[:-1][same]] = True
        later = np.zeros(len(self.hash), bool)
        later[order[1:][same]] = True
        self.distinct = np.flatnonzero(~later)

    def rows(self, chosen: np.ndarray, bucket: np.ndarray, settled: bool) -> pa.RecordBatch:
        """One row for each bucket of the ``chosen`` windows, whose buckets are ``bucket``."""
        order = np.argsort(bucket, kind="stable")
        chosen, bucket = chosen[order], bucket[order]
        first, lengths = _runs(self.owner[chosen], self.place[chosen], bucket, self.repeated[chosen])
        pieces = -(-lengths // _LONGEST)
        if pieces.max() > 1:
            own = np.repeat(np.arange(len(first)), pieces)
            done = _LONGEST * (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            first, lengths = first[own] + done, np.minimum(_LONGEST, lengths[own] - done)
        ends = _changes(bucket)
        home = bucket[ends]
        windows, runs = np.append(ends, len(chosen)), np.append(np.searchsorted(first, ends), len(first))
        owner = self.owner[chosen[first]]
        texts = _changes(bucket[first], owner)  # runs of a text in a bucket stand together
        in_bucket = np.append(np.searchsorted(texts, runs[:-1]), len(texts))
        flags = lengths.astype(np.uint8) | np.where(self.repeated[chosen[first]], _SETTLED, np.uint8(0))
        hashes = _binary(self.hash[chosen], windows) if not settled else pa.array([b""] * len(home), pa.binary())
        by_text = [_binary(c, in_bucket) for c in (self.texts[owner[texts]], self.checks[owner[texts]], np.diff(np.append(texts, len(first))).astype(np.uint32))]
        by_run = [_binary(c, runs) for c in (self.place[chosen[first]].astype(np.uint32), flags)]
        return pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array([settled] * len(home)), hashes, *by_text, *by_run], names=_NAMES)


class Plan:
    """Buckets, the most loaded of which are split: window -> final bucket.

    Only split buckets are held: their first part keeps the bucket's number, the others get numbers after all buckets.
    """

    def __init__(self, heavy: dict[int, int], buckets: int, fair: float):
        self.buckets = buckets
        self.heavy = np.array(sorted(heavy), np.int64)
        self.parts = np.array([int(np.ceil(heavy[b] / max(1.0, fair))) for b in self.heavy.tolist()], np.int64)
        self.first = np.cumsum([buckets, *(self.parts - 1)])
        self.total = int(self.first[-1])

    def of(self, hashes: np.ndarray, least: np.ndarray) -> np.ndarray:
        home = (least % np.uint64(self.buckets)).astype(np.int64)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, home), len(self.heavy) - 1)
            split = np.flatnonzero(self.heavy[at] == home)
            at = at[split]
            part = (mixed(hashes[split] + RADIX) % self.parts[at].astype(np.uint64)).astype(np.int64)
            home[split] = np.where(part == 0, home[split], self.first[at] + part - 1)
        return home


def _planned(rows: DataFrame, buckets: int, width: int, inner: int, one_in: int) -> Plan:
    """Distinct windows by bucket of one text in ``one_in``; a task answers with a row for each bucket it met."""

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = WordHashes(), {}
        for batch in batches:
            for part in slices(batch, "body"):
                own = _Slice(part, cache, width, inner)
                if not own.empty:
                    bucket, n = np.unique(own.least[own.distinct] % np.uint64(buckets), return_counts=True)
                    for b, m in zip(bucket.tolist(), n.tolist(), strict=True):
                        total[b] = total.get(b, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    sample = rows.filter(F.expr(f"pmod(text_hash, {one_in}) = 0")).mapInArrow(loads, "bucket long, n long")
    counted = sample.groupBy("bucket").agg(F.sum("n").alias("n"))
    fair = (counted.agg(F.sum("n")).first()[0] or 0) / buckets
    heaviest = counted.filter(F.col("n") > _UNEVEN * fair).orderBy(F.desc("n"), "bucket").limit(_MOST_SPLIT)  # what stays whole is counted all the same
    return Plan({r.bucket: r.n for r in heaviest.collect()}, buckets, fair)


def _scatter(plan, width: int, inner: int):
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for part in slices(batch, "body"):
                own = _Slice(part, cache, width, inner)
                if own.empty:
                    continue
                again = np.flatnonzero(own.repeated)
                if len(again):  # settled here: sent where its text's other answers do not repeat it
                    yield own.rows(again, (mixed(own.texts.view(np.uint64)) % np.uint64(plan.value.total)).astype(np.int64)[own.owner[again]], True)
                yield own.rows(own.distinct, plan.value.of(own.hash[own.distinct], own.least[own.distinct]), False)

    return scatter


_KEY = np.dtype([("text", np.int64), ("check", np.uint32)])


def _flat(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The binary values of a column, end to end."""
    parts = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        if len(chunk) and data is not None:
            ends = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts).view(kind) if parts else np.empty(0, kind)


def _runs_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text keys, starts, lengths) of all runs of the rows."""
    texts = _flat(table.column("texts"), np.int64)
    keys = np.empty(len(texts), _KEY)
    keys["text"], keys["check"] = texts, _flat(table.column("checks"), np.uint32)
    return np.repeat(keys, _flat(table.column("counts"), np.uint32)), _flat(table.column("starts"), np.uint32).astype(np.int64), _flat(table.column("lengths"), np.uint8)


def _count(width: int):
    def count(table: pa.Table) -> pa.Table:
        done = table.column("settled")
        keys, starts, lengths = _runs_of(table.filter(done))
        done_keys, done_starts, done_lengths = [keys], [starts], [(lengths & ~_SETTLED).astype(np.int64)]
        table = table.filter(pc.invert(done))
        h = _flat(table.column("hashes"), np.uint64)
        if len(h):
            keys, starts, lengths = _runs_of(table)
            single, lengths = lengths < _SETTLED, (lengths & ~_SETTLED).astype(np.int64)
            alone, keys, starts = np.repeat(single, lengths), np.repeat(keys, lengths), np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(h))
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            repeated = np.zeros(len(h), bool)
            repeated[order[1:][same]] = True
            repeated[order[:-1][same]] = True
            mine = np.flatnonzero(repeated & alone)
            if len(mine):
                keys, starts = keys[mine], starts[mine]
                order = np.lexsort((starts, keys["check"], keys["text"]))
                keys, starts = keys[order], starts[order]
                new = _changes(keys["text"], keys["check"], starts)  # copies of a text in other slices
                keys, starts = keys[new], starts[new]
                first, lengths = _runs(keys["text"], starts, keys["check"])
                done_keys.append(keys[first])
                done_starts.append(starts[first])
                done_lengths.append(lengths)
        keys, s = np.concatenate(done_keys), np.concatenate(done_starts)
        e = s + np.concatenate(done_lengths) + width - 2
        order = np.lexsort((s, keys["check"], keys["text"]))
        keys, s, e = keys[order], s[order], e[order]
        # intervals of a text that touch become one; numbers of texts keep their ends apart
        number = np.zeros(len(s), np.int64)
        number[_changes(keys["text"], keys["check"])[1:]] = 1
        apart = np.cumsum(number) * (int(e.max(initial=0)) + 2)
        reach = np.maximum.accumulate(e + apart) if len(e) else e
        new = np.flatnonzero(np.concatenate([[True], s[1:] + apart[1:] > reach[:-1] + 1])) if len(s) else np.empty(0, np.int64)
        last = np.append(new[1:], len(s)) - 1 if len(s) else new
        columns = (keys["text"][new], keys["check"][new].astype(np.int64), s[new].astype(np.int32), (reach - apart)[last].astype(np.int32))
        return pa.table([pa.array(c) for c in columns], names=["text_hash", "text_check", "first", "last"])

    return count


def merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals of the inclusive ones given."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    cut = np.flatnonzero(first[1:] > reach[:-1] + 1) + 1
    return list(zip(first[np.concatenate([[0], cut])].tolist(), reach[np.concatenate([cut - 1, [len(first) - 1]])].tolist(), strict=True))


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 35, inner: int = 20, bucket_bytes: int = 8 << 20, planned_one_in: int = 16) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, removed (maximal intervals of word places, both ends
    included) and text, the words left joined by one space (null for a null text)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    rows = rows.withColumn("text_hash", F.xxhash64("body")).withColumn("text_check", F.coalesce(F.crc32("body"), F.lit(0)))
    small_batches(docs.sparkSession)
    total = rows.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    bodies = rows.select("text_hash", "text_check", "body")
    plan = _planned(bodies, max(1, -(-int(total) // bucket_bytes)), width, inner, planned_one_in)
    buckets = plan.total
    fragments = bodies.mapInArrow(_scatter(docs.sparkSession.sparkContext.broadcast(plan), width, inner), _FRAGMENT)
    runs = fragments.repartition(min(buckets, _MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(_count(width), "text_hash long, text_check long, first int, last int")
    # a table, so that the join below has two shuffled sides, of which Spark can split a text's many copies
    by_text = written(runs.groupBy("text_hash", "text_check").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last")), "intervals")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                out = []
                for doc, body, first, last in zip(*(part.column(c).to_pylist() for c in ("doc_id", "body", "first", "last")), strict=True):
                    words = (body or b"").split()
                    spans = merged(np.array(first), np.array(last)) if first else []
                    keep = np.ones(len(words), np.uint8)
                    for a, b in spans:
                        keep[a : b + 1] = 0
                    left = None if body is None else b" ".join(itertools.compress(words, keep.tolist()) if spans else words)
                    out.append((doc, len(words), len(words) - int(keep.sum()), [{"first": a, "last": b} for a, b in spans], left))
                doc, n, gone, spans, left = zip(*out, strict=True)
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(left, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "removed", "text"],
                )

    found = rows.join(by_text, ["text_hash", "text_check"], "left").select("doc_id", "body", "first", "last")
    return found.mapInArrow(remove, "doc_id long, n_words long, n_removed long, removed array<struct<first: int, last: int>>, text string")
