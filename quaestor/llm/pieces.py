"""Ids of whole texts with a sentencepiece BPE model, and texts of ids, by a table of last pieces.

The encoding of a prefix of a text is the encoding of a shorter prefix followed by one piece, so
each prefix has exactly one last piece.  An automaton of all pieces lists those that end at a
place; the last piece is the one that is compatible with the last piece of the prefix before it,
that is, merging the two side by side leaves them as they are.  Going back from the end of the
text over the table gives the ids.  A test of a pair merges its characters once and is kept.

No piece joins other characters to a following space mark, so a text is cut before each mark that
follows another character, and at characters that only stand alone; each distinct part is solved
once for as long as it stays in the cache of its Python worker.

A null text is empty and gives the begin and end ids alone; rows that share a doc_id are encoded
one by one; an empty table gives an empty result.  A text is held whole by one task, which needs
memory in proportion to it.  Models that are not BPE, that normalize characters, or that hold
user-defined or unused pieces are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .words import slices

MARK = "▁"


class _Units(dict):
    """unit -> its number; units seen for the first time get the next number and wait in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        value = self[unit] = len(self)
        self.fresh.append(unit)
        return value


class _Last(dict):
    """A piece as the last one of a prefix: what follows it -> that piece if the two are compatible, else False."""

    __slots__ = ("piece", "ids", "size")

    def __init__(self, piece: str, ids: list[int]):
        self.piece, self.ids, self.size = piece, ids, len(piece)


class PieceEncoder:
    def __init__(self, path: str, limit: int = 1_000_000):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        names, rules = model.trainer_spec, model.normalizer_spec
        odd = {kinds.USER_DEFINED, kinds.UNUSED} & {p.type for p in model.pieces}
        if names.model_type != names.BPE or odd or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or names.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: not a BPE model of plain pieces without normalization")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE} if names.byte_fallback else {}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError(f"{path}: pieces that hold a space mark after other characters")
        self.joined = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        alone = "".join(c for c in "\n\r\t" if not any(c in pair for pair in self.joined))
        self._cut = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.last, self.start = {p: _Last(p, [k]) for p, k in ids.items()}, _Last("", [])
        self.single = {p for p in ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece in ids:
            self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.kind = np.uint16 if len(model.pieces) <= 1 << 16 else np.uint32
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.place = _Units()
        self.flat, self.used = np.empty(1 << 16, self.kind), 0
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best pair first, of equal ones the leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                value = score.get(parts[k] + parts[k + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _after(self, before: _Last, piece: str) -> _Last | bool:
        """``piece`` if it and the piece before stay as they are when merged side by side; with nothing before, if it arises at all."""
        parts = [before.piece, piece] if before.size else [piece]
        value = before[piece] = self.last[piece] if self._merged(before.piece + piece) == parts else False
        return value

    def _unknown(self, char: str) -> _Last:
        """A character that is no piece, for one text: it merges like others and ends as its bytes or as the unknown id."""
        return _Last(char, [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown])

    def _table(self, part: str, last: list[_Last | None]) -> list[int]:
        """The ids of a part: fills in the last piece of each of its prefixes that is not known yet, then goes back from its end."""
        if self.single.issuperset(part):
            for at, (piece, size) in self.automaton.iter(part):
                if last[at + 1] is None:
                    before = last[at + 1 - size]
                    found = before.get(piece)
                    if found is None:
                        found = self._after(before, piece)
                    if found is not False:
                        last[at + 1] = found
        else:
            ending: dict[int, list[str]] = {}
            for at, (piece, _) in self.automaton.iter(part):
                ending.setdefault(at, []).append(piece)
            for at, char in enumerate(part):
                for piece in [*ending.get(at, ()), *([] if char in self.single else [char])]:
                    before = last[at + 1 - len(piece)]
                    parts = [before.piece, piece] if before.size else [piece]
                    if self._merged("".join(parts)) == parts:
                        last[at + 1] = self.last[piece] if piece in self.last else self._unknown(piece)
                        break
        out, at = [], len(part)
        while at:
            found = last[at]
            out.append(found.ids)
            at -= found.size
        return [k for ids in reversed(out) for k in ids]

    def _parts(self, unit: str) -> list[str]:
        """The unit cut between characters that stand side by side in no piece."""
        pairs = list(map(add, unit, unit[1:]))
        if self.joined.issuperset(pairs):
            return [unit]
        out, begin = [], 0
        for k, pair in enumerate(pairs, 1):
            if pair not in self.joined:
                out.append(unit[begin:k])
                begin = k
        out.append(unit[begin:])
        return out

    def _solved(self, parts: list[str]) -> dict[str, list[int]]:
        """Ids of sorted parts: each takes over the table of the prefix that it shares with the one before it."""
        before, last, out = "", [self.start], {}
        for part in parts:
            k, most = 0, min(len(before), len(part))
            while k < most and before[k] == part[k]:
                k += 1
            last = last[: k + 1] + [None] * (len(part) - k)
            out[part] = self._table(part, last)
            before = part
        return out

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return self._cut.findall((self.prefix + text).replace(" ", MARK))

    def _learn(self) -> None:
        fresh, self.place.fresh = self.place.fresh, []
        known = len(self.place) - len(fresh)
        parts = list(map(self._parts, fresh))
        solved = self._solved(sorted(set(chain.from_iterable(parts))))
        found = [solved[p[0]] if len(p) == 1 else [k for part in p for k in solved[part]] for p in parts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while known + len(fresh) > len(self.first):
            self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[known : known + len(fresh)] = self.used + np.cumsum(sizes) - sizes
        self.size[known : known + len(fresh)] = sizes
        self.used += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of each text, begin and end included, as 32-bit little-endian integers."""
        if len(self.place) > self.limit:
            self._forget()
        numbers = []
        for text in texts:
            units = self.units(text)
            numbers.append(np.fromiter(map(self.place.__getitem__, units), np.int32, len(units)))
        if self.place.fresh:
            self._learn()
        return [self._gathered(at) for at in numbers]

    def _gathered(self, at: np.ndarray) -> np.ndarray:
        sizes = self.size[at]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        inner = self.flat[np.repeat(self.first[at] - (after - sizes), sizes) + np.arange(total)]
        if not self.bytes and total:  # neighbouring unknown characters are one unknown id
            inner = inner[np.concatenate([[True], (inner[1:] != self.unknown) | (inner[:-1] != self.unknown)])]
        out = np.empty(len(inner) + 2, "<u4")
        out[0], out[1:-1], out[-1] = self.begin, inner, self.end
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The library's own text of the ids."""
        return self.library.decode(ids.tolist())


_KEPT: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker for that file."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = PieceEncoder(path)
    return _KEPT[path]


def encoded(docs: DataFrame, *, model: str, with_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (unsigned 32-bit little-endian, in a row); ``with_text``: also what the ids decode to."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    names = ["doc_id", "n_tokens", "ids"] + (["decoded"] if with_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = piece_encoder(model)
        for batch in batches:
            for part in slices(batch, "body"):
                ids = code.encode([body.decode("utf-8", "replace") for body in part.column("body").to_pylist()])
                out = [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if with_text:
                    out.append(pa.array([code.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + (", decoded string" if with_text else ""))


def decoded(rows: DataFrame, *, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: doc_id and the text of its ids (null without ids)."""
    small_batches(rows.sparkSession)
    given = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = piece_encoder(model)
        for batch in batches:
            for part in slices(batch, "ids"):
                texts = [None if x is None else code.decode(np.frombuffer(x, "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return given.mapInArrow(run, "doc_id long, text string")
