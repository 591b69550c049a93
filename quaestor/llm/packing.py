"""Packing of token ids into sequences of a fixed length by non-negative least squares.

Each document's ids are cut into whole sequences, one piece of a multiple of ``unit`` ids and
a tail below ``unit``, all known from its length alone.  The pieces' lengths form a histogram
of bounded size, whatever the corpus.  Shallow combinations of unit multiples that fill the
window exactly are enumerated; non-negative least squares finds how often to repeat each so
that the histogram is met; the counts are rounded down; what remains, and all tails, is packed
greedily, longest first, as repeated combinations too.  A piece's rank within its length then
gives its sequence and offset by arithmetic, so no piece is moved to be placed.

Empty cases: a null text is empty and holds only its end id.  Rows that share a doc_id are
documents of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoders import encoder
from .scratch import small_batches, written
from .words import slices

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long"


def cuts(tokens: int, window: int, unit: int) -> list[int]:
    """Lengths of a document's pieces, in order."""
    whole, rest = divmod(tokens, window)
    tail = rest % unit
    return [window] * whole + [n for n in (rest - tail, tail) if n]


def combinations(total: int, depth: int, most: int | None = None) -> list[tuple[int, ...]]:
    """Descending tuples of at most ``depth`` positive integers that sum to ``total``."""
    if total == 0:
        return [()]
    if depth == 0:
        return []
    top = min(total, most or total)
    return [(k, *rest) for k in range(top, 0, -1) if k * depth >= total for rest in combinations(total - k, depth - 1, k)]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        enter = int(np.argmax(gradient))
        if gradient[enter] <= slack:
            break
        passive[enter] = True
        while True:
            trial = np.zeros_like(x)
            trial[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (trial <= 1e-12)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + step * (trial - x)
            passive &= x > 1e-12
            x[~passive] = 0
    return x


def plan(histogram: dict[int, int], window: int, unit: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, times it is used), which together use the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    grid = [n for n in left if n % unit == 0]
    if grid:
        patterns = [p for p in combinations(window // unit, depth) if all(k * unit in left for k in p)]
        if patterns:
            a = np.zeros((window // unit, len(patterns)))
            for j, p in enumerate(patterns):
                for k in p:
                    a[k - 1, j] += 1
            b = np.array([left.get((k + 1) * unit, 0) for k in range(window // unit)], float)
            for p, x in sorted(zip(patterns, nnls(a, b), strict=True), key=lambda z: -z[1]):
                need = {k * unit: p.count(k) for k in p}
                times = min([int(x + 1e-6), *(left.get(n, 0) // m for n, m in need.items())])
                if times > 0:
                    out.append((tuple(k * unit for k in p), times))
                    for n, m in need.items():
                        left[n] -= m * times
    left = {n: c for n, c in left.items() if c}
    while left:
        room, chosen = window, {}
        for n in sorted(left, reverse=True):
            if take := min(room // n, left[n]):
                chosen[n] = take
                room -= take * n
        times = min(left[n] // m for n, m in chosen.items())
        out.append((tuple(n for n, m in chosen.items() for _ in range(m)), times))
        left = {n: c - chosen.get(n, 0) * times for n, c in left.items() if c - chosen.get(n, 0) * times}
    return out


def _pieces(docs: DataFrame, tokenizer: str, keeps_space: bool, end: int, window: int, unit: int, units: int, block: int, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = encoder(tokenizer, keeps_space, units), TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, "body"):
                ids, starts = code.encode(part.column("body").to_pylist(), end, block)
                ids = ids.astype("<u4")
                out = []
                for doc, at, n in zip(part.column("doc_id").to_pylist(), starts[:-1].tolist(), np.diff(starts).tolist(), strict=True):
                    begin = 0
                    for length in cuts(n, window, unit):
                        rank = ranks[length] = ranks.get(length, -1) + 1
                        out.append((doc, begin, length, zlib.crc32(ids[at + begin : at + begin + length].tobytes()), n, task, rank))
                        begin += length
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return rows.mapInArrow(cut, _PIECES)


def packed(
    docs: DataFrame, *, tokenizer: str, keeps_space: bool = False, end: int = 1, window: int = 2048, unit: int = 64,
    depth: int = 4, units: int = 600_000, block: int = 1 << 22, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece (``units``: distinct words that a worker's encoder remembers, ``block``: bytes it encodes at once): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    pieces = written(_pieces(docs, tokenizer, keeps_space, end, window, unit, units, block, doc_id, text), "pieces")
    counts = written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window / unit + unit rows
    segments: dict[int, list[tuple[int, int, int, int]]] = {}
    used, first = {}, 0
    for lengths, times in plan(histogram, window, unit, depth):
        offset = 0
        for n in dict.fromkeys(lengths):
            m = lengths.count(n)
            segments.setdefault(n, []).append((used.get(n, 0), m, first, offset))
            used[n] = used.get(n, 0) + m * times
            offset += m * n
        first += times
    table = {n: np.array(rows, np.int64) for n, rows in segments.items()}
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("length", "task", before.alias("before")), ["length", "task"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros_like(length), np.zeros_like(length)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                t = table[int(n)][np.searchsorted(table[int(n)][:, 0], rank[mine], "right") - 1]
                instance, slot = np.divmod(rank[mine] - t[:, 0], t[:, 1])
                sequence[mine], offset[mine] = t[:, 2] + instance, t[:, 3] + slot * n
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
