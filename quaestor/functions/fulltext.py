"""Ranked full-text search over several fields of documents, from postings in Parquet tables.

A posting is a term in a field of a document with its places; a document also has one row without
a term for each field, which gives its lengths.  Postings are filed by a hash of their terms
(``shelf``), sorted by term, and in several files a shelf where there are many, so that a query
reads the shelves of its own words.  Who keeps postings up to date says which rows count and how
many documents and words there are (``operators.ingest`` does); ``indexed`` writes those of one table.

Terms are stems of lower-case words without accents.  A phrase must stand in one field, all terms
of another query may stand in different ones.  Scores are BM25 with a weight for each field: places
count by weight, and lengths are of the whole document, or of each field by itself (``by_field``).
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.search import K1, B, stem

FIELDS = ("title", "text", "category", "source")
POSTINGS = "doc_id long, field string, term string, places array<int>, field_words int, doc_words int"
#: Files of postings by a hash of the term; rows without a term have a shelf of their own.
SHELVES, LENGTHS = 64, -1
_WORD = re.compile(r"[^\W_]+")


@functools.lru_cache(1 << 18)
def term_of(word: str) -> str:
    """The term of a lower-case word: its letters without accents, stemmed."""
    if word.isdigit() and word.isascii():
        return word
    plain = word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return stem(plain)


def _words(text: str) -> Iterator[re.Match]:
    return _WORD.finditer(text)


def _lowered(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order."""
    return [term_of(w) for w in _WORD.findall(_lowered(text or ""))]


def postings(documents: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "id") -> DataFrame:
    """``POSTINGS`` of documents; a null field has no words.  Nothing is shuffled: a document's words are gathered where it is read."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), *(F.col(f).cast("string").alias(f) for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "field", "term", "places", "field_words", "doc_words"]
        kinds = pa.array(fields)

        def filed(docs: list, nth: list, sizes: list, totals: list, rows: list, terms: list, flat: list, ends: list) -> pa.RecordBatch:
            """Postings of fields, each with its document, place among ``fields``, words, words of the document and number of rows."""
            of = np.repeat(np.arange(len(docs)), rows)
            ids, field, own, total = (pa.array(x, t).take(of) for x, t in ((docs, pa.int64()), (nth, pa.int32()), (sizes, pa.int32()), (totals, pa.int32())))
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays([ids, kinds.take(field), pa.array(terms, pa.string()), places, own, total], names=names)

        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], [], [0]]
            docs, nth, sizes, totals, rows, every, flat, ends = out
            for doc, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                found = [terms_of(x) for x in texts]
                total = sum(map(len, found))
                for k, terms in enumerate(found):
                    places: dict[str, list[int]] = {"": []}
                    for at, term in enumerate(terms):
                        if term in places:
                            places[term].append(at)
                        else:
                            places[term] = [at]
                    docs.append(doc), nth.append(k), sizes.append(len(terms)), totals.append(total), rows.append(len(places))
                    every += places
                    for own in places.values():
                        flat += own
                        ends.append(len(flat))
                if len(every) > 100_000:
                    yield filed(*out)
                    out = [[], [], [], [], [], [], [], [0]]
                    docs, nth, sizes, totals, rows, every, flat, ends = out
            if every:
                yield filed(*out)

    return rows.mapInArrow(run, POSTINGS)


def _shelf() -> Column:
    return F.when(F.col("term") == "", LENGTHS).otherwise(F.pmod(F.crc32(F.encode(F.col("term"), "UTF-8")), F.lit(SHELVES)).cast("int"))


def write_postings(rows: DataFrame, path: str, size: int) -> None:
    """Writes postings by shelf; ``size`` is about the number of characters they come from.

    A shelf has one file for each 16 million of them, at most 256, so that neither a common word nor a large table makes one task grow.
    """
    parts = max(1, min(256, size // (16 << 20)))
    filed = rows.withColumn("shelf", _shelf()).withColumn("file", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    filed.repartition(max(1, min((SHELVES + 1) * parts, size >> 19)), "shelf", "file").drop("file").sortWithinPartitions("shelf", "term", "doc_id").write.mode("overwrite").partitionBy("shelf").parquet(path)


def extents(rows: DataFrame) -> dict[str, tuple[int, int]]:
    """field -> (documents, words), of rows that hold the lengths; at most a row a field is collected."""
    found = rows.filter(F.col("shelf") == LENGTHS).groupBy("field").agg(F.count("*").alias("docs"), F.sum("field_words").alias("words")).collect()
    return {r.field: (r.docs, r.words) for r in found}


@dataclass
class Fulltext:
    """Postings that count (with their ``shelf``), the number of documents and the words of each field."""

    rows: DataFrame
    docs: int
    words: dict[str, int]

    def of(self, terms: list[str]) -> DataFrame:
        """Postings of some terms, from their shelves alone."""
        shelves = sorted({zlib.crc32(t.encode()) % SHELVES for t in terms})
        return self.rows.filter(F.col("shelf").isin(shelves) & F.col("term").isin(sorted(set(terms))))


def tasks(size: int) -> int:
    """Tasks that about ``size`` characters of documents are dealt to: two million each up to 64 tasks, then at most 16 million, up to 4096."""
    return max(1, min(64, size >> 21), min(4096, size >> 24))


def indexed(documents: DataFrame, folder: str, fields: tuple[str, ...] = FIELDS, doc_id: str = "id", size: int | None = None) -> Fulltext:
    """Writes the postings of documents below ``folder`` and gives the index over them; ``size`` is about their number of characters, counted unless given.

    Documents, not postings, are shuffled: each task writes those of its own, sorted, to a file a shelf.
    """
    if size is None:
        size = documents.agg(F.sum(sum((F.coalesce(F.length(f), F.lit(0)) for f in fields), F.lit(0)))).first()[0] or 0
    dealt = documents.repartition(tasks(size), doc_id)
    filed = postings(dealt, fields, doc_id).withColumn("shelf", _shelf()).sortWithinPartitions("shelf", "term", "doc_id")
    filed.write.mode("overwrite").option("compression", "zstd").partitionBy("shelf").parquet(f"{folder}/postings")
    rows = _read(documents.sparkSession, f"{folder}/postings")
    found = extents(rows)
    return Fulltext(rows, max((n for n, _ in found.values()), default=0), {f: w for f, (_, w) in found.items()})


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS + ", shelf int").parquet(path)


def matches(index: Fulltext, query: str, phrase: bool = True) -> DataFrame:
    """(doc_id, unit, field, tf, field_words, doc_words): where the phrase stands, or each term of documents that hold all; none for an empty query."""
    terms = terms_of(query)
    spark = index.rows.sparkSession
    if not terms:
        return spark.createDataFrame([], "doc_id long, unit string, field string, tf long, field_words int, doc_words int")
    hits = index.of(terms)
    if not phrase or len(terms) == 1:
        found = hits.select("doc_id", F.col("term").alias("unit"), "field", F.size("places").cast("long").alias("tf"), "field_words", "doc_words")
        if len(set(terms)) == 1:
            return found
        full = found.groupBy("doc_id").agg(F.count_distinct("unit").alias("n")).filter(F.col("n") == len(set(terms)))
        return found.join(full.select("doc_id"), "doc_id", "left_semi")
    wanted = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, nth int")  # as many rows as the query has words
    placed = hits.join(F.broadcast(wanted), "term").select("doc_id", "field", F.expr("transform(places, p -> p - nth)").alias("starts"), "field_words", "doc_words")
    # places are compared in fields that hold every term
    held = placed.groupBy("doc_id", "field").agg(F.collect_list("starts").alias("s"), F.first("field_words").alias("field_words"), F.first("doc_words").alias("doc_words")).filter(F.size("s") == len(terms))
    whole = held.withColumn("tf", F.expr("CAST(size(aggregate(s, s[0], (x, y) -> array_intersect(x, y))) AS BIGINT)")).filter("tf > 0")
    return whole.select("doc_id", F.lit(" ".join(terms)).alias("unit"), "field", "tf", "field_words", "doc_words")


def search(index: Fulltext, query: str, *, phrase: bool = True, k: int | None = 20, weights: dict[str, float] | None = None, by_field: bool = False) -> DataFrame:
    """(doc_id, score), best first, ties by id.  ``weights`` are of fields (1 where none is given); a field of weight 0 matches but adds nothing."""
    found = matches(index, query, phrase)
    per = lambda values, other: F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("field")], F.lit(other)) if values else F.lit(other)
    part = per({f: float(w) for f, w in (weights or {}).items()}, 1.0) * F.col("tf")
    if by_field:
        mean = per({f: max(1.0, w / max(1, index.docs)) for f, w in index.words.items()}, 1.0)
        part = part / (1 - B + B * F.col("field_words") / mean)
    units = found.groupBy("doc_id", "unit").agg(F.sum(part).alias("f"), F.max("doc_words").alias("length"))
    rare = units.groupBy("unit").agg(F.count("*").alias("df"))  # as many rows as the query has words
    idf = F.greatest(F.log((F.lit(index.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    mean = max(1e-9, sum(index.words.values()) / max(1, index.docs))
    norm = F.lit(K1) if by_field else K1 * (1 - B + B * F.col("length") / F.lit(mean))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + norm)
    scored = units.join(F.broadcast(rare), "unit").groupBy("doc_id").agg(F.round(F.sum(part), 9).alias("score"))  # rounded: a sum may come in any order
    ordered = scored.orderBy(F.col("score").desc(), "doc_id")
    return ordered if k is None else ordered.limit(k)


def excerpt(text: str | None, terms: list[str], phrase: bool = True, size: int = 40, marks: tuple[str, str] = ("<mark>", "</mark>")) -> str | None:
    """``size`` words of a text around the stretch that holds most different terms, then most matches, then comes first; matches are marked.

    The first words where nothing matches; dots stand for what is left out.
    """
    if text is None:
        return None
    words = [(m.start(), m.end(), term_of(_lowered(m.group()))) for m in _words(text)]
    if not words:
        return text
    own = [w[2] for w in words]
    if phrase and len(terms) > 1:
        found = [(k, k + len(terms), "") for k in range(len(own) - len(terms) + 1) if own[k] == terms[0] and own[k : k + len(terms)] == terms]
    else:
        found = [(k, k + 1, t) for k, t in enumerate(own) if t in terms]
    begin = 0
    if found:
        best, span, held, left = (0, 0), found[0][:2], Counter(), 0
        for first, end, term in found:  # a window over the matches: the later end moves on, the earlier follows
            held[term] += 1
            while end - found[left][0] > size and found[left][0] < first:
                held[found[left][2]] -= 1
                held += Counter()
                left += 1
            value = (len(held), sum(held.values()))
            if value > best:
                best, span = value, (found[left][0], end)
        begin = max(0, min(span[0] - max(0, size - (span[1] - span[0])) // 2, len(words) - size))
    end = min(len(words), begin + size)
    out, at = [], 0 if begin == 0 else words[begin][0]
    until = len(text) if end == len(words) else words[end - 1][1]
    for first, last, _ in found:
        if first >= begin and last <= end and words[first][0] >= at:
            out += [text[at : words[first][0]], marks[0], text[words[first][0] : words[last - 1][1]], marks[1]]
            at = words[last - 1][1]
    return ("..." if begin else "") + "".join(out) + text[at:until] + ("..." if end < len(words) else "")


def excerpts(text: Column, query: str, phrase: bool = True, size: int = 40, marks: tuple[str, str] = ("<mark>", "</mark>")) -> Column:
    """Column: ``excerpt`` of each text, for the rows of a page of results."""
    terms = terms_of(query)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: excerpt(x, terms, phrase, size, marks))

    return cut(text)
