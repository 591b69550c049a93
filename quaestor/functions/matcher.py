"""Many words or names looked for in texts at once, by an Aho-Corasick automaton in each Python worker.

Patterns are broadcast, in shards of bounded size where they are many; each shard is one pass over
the texts.  ``claims`` gives the stretches that patterns claim from left to right, longer ones
before shorter ones at the same place, by label; ``counts`` the number of times that each of some words
occurs, by itself, without overlaps.  Texts and patterns meet in lower case, letter by letter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of patterns that one broadcast holds.
LIMIT = 16 << 20
_FOUND = "document_id long, label string, start int, end int, pattern string"


def lowered(text: str) -> str:
    """The text in lower case, as long as it was: a letter whose small form has several is kept."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(patterns: dict[str, list[str]]):
    """An automaton of lower-case patterns; each gives (its length, its labels)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for pattern, labels in patterns.items():
        out.add_word(pattern, (len(pattern), labels))
    out.make_automaton()
    return out


def _claimed(found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Of stretches those that no earlier one touches: the leftmost first, at one place the longest."""
    until = 0
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= until:
            yield start, end
            until = end


def claims(documents: DataFrame, patterns: DataFrame, *, doc_id: str = "id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(document_id, label, start, end, pattern) of the claims of each label's patterns (``label``, ``pattern``) in each text."""
    spark = documents.sparkSession
    known = patterns.select("label", F.lower("pattern").alias("pattern")).filter("pattern <> ''").distinct()
    size = known.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // limit))
    rows = documents.select(F.col(doc_id).cast("long").alias("document_id"), F.col(text).cast("string").alias("body"))
    out = None
    for shard in range(shards if size else 0):
        own = known if shards == 1 else known.filter(F.pmod(F.xxhash64(F.substring("pattern", 1, 2)), F.lit(shards)) == shard)
        held: dict[str, list[str]] = {}
        for r in own.toLocalIterator():  # about ``limit`` characters
            held.setdefault(lowered(r.pattern), []).append(r.label)
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words = automaton(shared.value)
            for batch in batches:
                found = []
                for document, body in zip(batch.column("document_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                    low, by_label = lowered(body or ""), {}
                    for last, (length, labels) in words.iter(low) if shared.value else ():
                        for label in labels:
                            by_label.setdefault(label, []).append((last + 1 - length, last + 1))
                    for label, places in by_label.items():
                        found += [(document, label, a, b, low[a:b]) for a, b in (_claimed(places) if shards == 1 else places)]
                for at in range(0, len(found), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[at : at + (1 << 16)]), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["document_id", "label", "start", "end", "pattern"])

        part = rows.mapInArrow(run, _FOUND)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], _FOUND)
    if shards == 1:
        return out

    def settle(found: pd.DataFrame) -> pd.DataFrame:
        keep = set(_claimed(list(zip(found["start"], found["end"]))))
        mine = [(a, b) in keep for a, b in zip(found["start"], found["end"])]
        return found[mine]

    return out.distinct().groupBy("document_id", "label").applyInPandas(settle, _FOUND)  # what one text holds of one label


def counted(text: str | None, words) -> dict[int, int]:
    """number of a word -> its occurrences that do not overlap each other, of an automaton whose labels are numbers."""
    out: dict[int, int] = {}
    until: dict[int, int] = {}
    for last, (length, labels) in words.iter(text) if text else ():
        for k in labels:
            if last + 1 - length >= until.get(k, 0):
                out[k] = out.get(k, 0) + 1
                until[k] = last + 1
    return out


def counter(words: list[str], present: bool):
    """A function of a column of texts, as they are: the occurrences of all words together, or how many of them occur."""
    held = {w: [k] for k, w in enumerate(dict.fromkeys(words))}
    weight = [words.count(w) for w in held]
    kept: list = []

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if not kept:
            kept.append(automaton(held))
        return texts.map(lambda x: sum(weight[k] * (1 if present else n) for k, n in counted(x, kept[0]).items()))

    return count


#: Counters by name, for SQL text: made when a plan is put together, registered when it runs.
COUNTERS: dict[str, tuple[list[str], bool]] = {}


def counter_name(words: list[str], present: bool) -> str:
    name = f"quaestor_{'present' if present else 'hits'}_{zlib.crc32(chr(0).join(words).encode()):08x}"
    if COUNTERS.setdefault(name, (words, present)) != (words, present):
        raise ValueError(f"two lists of words are called {name}")
    return name
