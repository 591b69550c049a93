"""Token ids of whole texts with a fast tokenizer file, through a cache of its context-free units.

Pre-tokenizers of these files never join characters across a break between a non-space and a
following ASCII space, so a text's ids are its units' ids in a row; each distinct unit is
encoded once for as long as it stays in the cache.  Arrow parts most texts and finds their
distinct units; texts with runs of white space are parted by a pattern, and those with white
space outside ASCII, that the tokenizer would normalize, or that hold the string of an added
token (which becomes that token's id, as the tokenizer makes it) are encoded as a whole.  So is
every text where the file's normalizer and pre-tokenizer are none of the known ones.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CONTROLS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_SPACES = b" \t\n\v\f\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True
#: Beyond the Latin blocks, where the tokenizer itself normalizes.
_FAR = re.compile("[^\x00-\u024f]")
_UNITS = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


#: (normalizers, pre-tokenizers) of files whose units are known to stand alone, by whether white space is part of the ids.
_KNOWN = {True: ([], ["ByteLevel"]), False: (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])}


def _kinds(step: dict | None, parts: str) -> list[str]:
    return [] if step is None else [s["type"] for s in step.get(parts, [step])]


class _Places(dict):
    """unit -> its number; units seen for the first time get the next number and wait in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, unit: bytes) -> int:
        value = self[unit] = len(self)
        self.fresh.append(unit)
        return value


class UnitEncoder:
    """``keeps_space``: white space is part of the ids (byte-level files), else it only separates words."""

    def __init__(self, path: str, keeps_space: bool, limit: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.joined = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.joined.encode_special_tokens = True  # no unit is an added token
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.known = (_kinds(parts.get("normalizer"), "normalizers"), _kinds(parts.get("pre_tokenizer"), "pretokenizers")) == _KNOWN[keeps_space]
        self.added = [t["content"].encode() for t in parts.get("added_tokens", [])]
        if not keeps_space:
            self.joined.normalizer = normalizers.Sequence([])
        self.keeps_space, self.limit = keeps_space, limit
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
        self.spans = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes that an id stands for
        for token, k in vocabulary.items():
            self.spans[k] = len(token.removesuffix("</w>"))
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        self.flat, self.used = np.empty(1 << 16, self.kind), 0
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _exact(self, text: bytes) -> np.ndarray:
        """Ids of a whole text just as the tokenizer gives them, added tokens included."""
        self.tokenizer.encode_special_tokens = False
        try:
            return self._whole(text.decode("utf-8", "replace"))
        finally:
            self.tokenizer.encode_special_tokens = True

    def _careful(self, text: bytes) -> bool:
        return not self.known or any(t in text for t in self.added)

    def _together(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and number of ids of units that may stand side by side, told apart by the bytes the ids stand for."""
        joined = (b"" if self.keeps_space else b" ").join(units).decode("utf-8", "replace")
        ids = np.array(self.joined.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
        until, ends = np.cumsum(self.spans[ids]), np.cumsum([len(u) for u in units])
        at = np.searchsorted(until, ends)
        if not len(ids) or until[-1] != ends[-1] or (until[at] != ends).any():
            return None
        return ids, np.diff(at, prepend=-1)

    def _learn(self) -> None:
        fresh, self.place.fresh = self.place.fresh, []
        known = len(self.place) - len(fresh)
        beside = np.array([k for k, u in enumerate(fresh) if u and (not self.keeps_space or u[0] in _SPACES and u[-1] not in _SPACES)], np.int64)
        done = self._together([fresh[k] for k in beside]) if len(beside) else None
        ids, sizes = done or (np.empty(0, self.kind), np.empty(0, np.int64))
        order = beside if done else np.empty(0, np.int64)
        alone = np.setdiff1d(np.arange(len(fresh)), order)
        parts = [self._whole(fresh[k].decode("utf-8", "replace")) for k in alone]
        ids, sizes, order = np.concatenate([ids, *parts]), np.concatenate([sizes, [len(p) for p in parts]]).astype(np.int64), np.concatenate([order, alone])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while known + len(fresh) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, self.begin]), np.concatenate([self.size, self.size])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[known + order] = self.used + np.cumsum(sizes) - sizes
        self.size[known + order] = sizes
        self.used += len(ids)

    def encode(self, texts: list[bytes | None], end: int, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each followed by ``end``; where each text starts, and the length of all)."""
        parts, counts, held, size = [], [], [], 0
        for text in texts:
            held.append(text or b"")
            size += len(held[-1])
            if size >= block:
                self._block(held, end, parts, counts)
                held, size = [], 0
        if held:
            self._block(held, end, parts, counts)
        return (np.concatenate(parts) if parts else np.empty(0, self.kind)), np.cumsum([0, *counts])

    def _plain(self, text: bytes) -> bytes | None:
        """The text as Arrow can part it into units: None if that takes more care."""
        if self._careful(text):
            return None
        if not self.keeps_space:
            if text.isascii():
                return text.lower()
            plain = text.decode("utf-8", "replace")
            return plain.lower().encode() if not _FAR.search(plain) and unicodedata.is_normalized("NFC", plain) else None
        if b"\x00" in text or any(c in text for c in _CONTROLS) or not text.isascii() and _ODD.search(text.decode("utf-8", "replace")):
            return None
        space = _IS_SPACE[np.frombuffer(text, np.uint8)]
        return None if (space[1:] & space[:-1]).any() else text  # runs of white space stay together

    def _parted(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of plain texts, and how many each has; Arrow finds the distinct ones."""
        column = pa.array(texts, pa.binary()).cast(pa.string())
        if self.keeps_space:
            for space in _SPACES.decode():
                column = pc.replace_substring(column, space, "\x00" + space)
            lists = pc.split_pattern(column, "\x00")
        else:
            lists = pc.ascii_split_whitespace(column)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        numbers = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        return numbers[coded.indices.to_numpy()], np.diff(lists.offsets.to_numpy())

    def _units(self, text: bytes) -> list[bytes] | None:
        """Units of a text that is not plain, None where the tokenizer must see it whole."""
        if not self.keeps_space or self._careful(text):
            return None
        odd = any(c in text for c in _CONTROLS) or not text.isascii() and _ODD.search(text.decode("utf-8", "replace"))
        return None if odd else _UNITS.findall(text)

    def _block(self, texts: list[bytes], end: int, parts: list[np.ndarray], counts: list[int]) -> None:
        if len(self.place) > self.limit:
            self._forget()
        nothing = np.array([self.place[b""]])
        plain = [self._plain(t) for t in texts]
        easy = [t for t in plain if t is not None]
        numbers, sizes = self._parted(easy) if easy else (np.empty(0, np.int64), [])
        easy_parts = iter(np.split(numbers, np.cumsum(sizes)[:-1])) if easy else iter(())
        at, whole = [], {}
        for k, text in enumerate(texts):
            if plain[k] is not None:
                at.append(next(easy_parts))
            elif (units := self._units(text)) is not None:
                at.append(np.fromiter(map(self.place.__getitem__, units), np.int64, len(units)))
            else:
                at.append(nothing[:0])
                whole[k] = self._exact(text)
            at.append(nothing)
        if self.place.fresh:
            self._learn()
        sizes = [len(a) + 1 for a in at[::2]]
        at = np.concatenate(at)
        begin, lengths = self.begin[at], self.size[at]
        last = np.cumsum(sizes) - 1
        lengths[last] = 1  # the end of a text
        after = np.cumsum(lengths)
        ids = self.flat[np.repeat(begin - (after - lengths), lengths) + np.arange(int(after[-1]))]
        ids[after[last] - 1] = end
        own_counts = np.diff(np.concatenate([[0], after[last]])).tolist()
        if not whole:
            parts.append(ids)
        else:
            start = 0
            for k, n in enumerate(own_counts):
                if k in whole:
                    parts.append(whole[k])
                    own_counts[k] += len(whole[k])
                parts.append(ids[start : start + n])
                start += n
        counts += own_counts


_KEPT: dict[tuple, UnitEncoder] = {}


def encoder(path: str, keeps_space: bool, limit: int = 1_200_000) -> UnitEncoder:
    """The encoder of this Python worker for that file."""
    if (path, keeps_space, limit) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, keeps_space, limit] = UnitEncoder(path, keeps_space, limit)
    return _KEPT[path, keeps_space, limit]
