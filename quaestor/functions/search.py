"""Full-text search: postings, Porter stems, phrase and all-terms matching, BM25 ranks, snippets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators.graph import cut

K1, B = 1.2, 0.75
_TOKEN = r"[\p{L}\p{N}]+"


def _measure(stem: str) -> int:
    return len(re.findall(r"[aeiouy]+[^aeiouy]+", _classes(stem)))


def _classes(word: str) -> str:
    """The word with y written as a consonant (z) where it is one."""
    out = ""
    for k, c in enumerate(word):
        out += "z" if c == "y" and (k == 0 or out[-1] in "aeiouy") else c
    return out


def _vowel(stem: str) -> bool:
    return any(c in "aeiouy" for c in _classes(stem))


def _cvc(stem: str) -> bool:
    c = _classes(stem)
    return len(c) >= 3 and c[-1] not in "aeiouywx" and stem[-1] not in "wxy" and c[-2] in "aeiouy" and c[-3] not in "aeiouy"


#: Porter's suffix rules of steps 2 to 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and _vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _classes(word)[-1] not in "aeiouy" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        end = max((e for e in rules if word.endswith(e)), key=len, default=None)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + rules[end]
    end = max((e for e in _STEP4 if word.endswith(e)), key=len, default=None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _cvc(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _worded(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).alias("doc_id"), F.expr(f"regexp_extract_all(lower({text}), '{_TOKEN.replace(chr(92), chr(92) * 2)}', 0)").alias("words"))


def postings(documents: DataFrame, *, doc_id: str = "id", text: str = "text", terms: list[str] | None = None) -> DataFrame:
    """(doc_id, term, pos, length): stemmed terms with their places, all or those among ``terms``.  Each distinct word is stemmed once."""
    placed = _worded(documents, doc_id, text).select("doc_id", F.size("words").alias("length"), F.posexplode("words").alias("pos", "word"))

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    words = placed.select("word")
    if terms is not None:  # a stem and its words start alike but for the stem's last letters
        words = words.filter(" OR ".join(f"startswith(word, '{t[: max(1, len(t) - 2)]}')" for t in terms) or "false")
    vocabulary = words.distinct().withColumn("term", stems("word"))
    if terms is not None:
        vocabulary = cut(vocabulary.filter(F.col("term").isin(terms)))
        if vocabulary.count() <= 10_000:  # the words of a query's stems
            vocabulary = F.broadcast(vocabulary)
    return placed.join(vocabulary, "word").select("doc_id", "term", "pos", "length")


def _extent(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row: number of documents with a word, and their mean number of words."""
    return _worded(documents, doc_id, text).filter("size(words) > 0").agg(F.count("*").alias("docs"), F.avg(F.size("words")).alias("mean"))


class Index:
    """Postings on disk, filed by a hash of their terms and sorted by term, so that a query reads those of its terms alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.postings, self.extent = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/extent")
        self.shelves = spark.read.parquet(f"{folder}/shelves").first()[0]

    @classmethod
    def write(cls, documents: DataFrame, folder: str, *, doc_id: str = "id", text: str = "text", shelves: int = 64) -> Index:
        shelf = F.pmod(F.xxhash64("term"), F.lit(shelves)).cast("int")
        rows = postings(documents, doc_id=doc_id, text=text).withColumn("shelf", shelf)
        rows.repartition(shelves, "shelf").sortWithinPartitions("shelf", "term").write.mode("overwrite").partitionBy("shelf").parquet(f"{folder}/postings")
        _extent(documents, doc_id, text).write.mode("overwrite").parquet(f"{folder}/extent")
        written = documents.sparkSession.createDataFrame([(shelves,)], "shelves int")
        written.write.mode("overwrite").parquet(f"{folder}/shelves")
        return cls(documents.sparkSession, folder)

    def of(self, terms: list[str]) -> DataFrame:
        """Postings of some terms; the shelves are partitions, of which only theirs are listed."""
        named = self.postings.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        on = named.select(F.pmod(F.xxhash64("term"), F.lit(self.shelves)).cast("int").alias("s")).distinct().collect()
        return self.postings.filter(F.col("shelf").isin([r.s for r in on]) & F.col("term").isin(terms)).drop("shelf")


def _terms(query: str) -> list[str]:
    return [stem(w) for w in re.findall(r"[^\W_]+", query.lower())]


def search(index: DataFrame | Index, query: str, *, phrase: bool = True, k: int | None = 20, extent: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): documents that hold the phrase (or all terms), by BM25, ties by id; an empty query finds none.

    ``index`` is an ``Index`` or a table of postings; of the latter ``extent`` is taken from it unless given.
    """
    terms = _terms(query)
    if isinstance(index, Index):
        index, extent = (index.of(terms) if terms else index.postings), index.extent
    spark = index.sparkSession
    if not terms:
        return spark.createDataFrame([], "doc_id long, score double")
    wanted = spark.createDataFrame([(t, p) for p, t in enumerate(terms)], "term string, place int")
    hits = index.join(F.broadcast(wanted), "term")  # as many rows as the query has words
    if phrase:
        starts = hits.groupBy("doc_id", (F.col("pos") - F.col("place")).alias("start")).agg(F.countDistinct("place").alias("n"), F.first("length").alias("length"))
        matched = starts.filter(F.col("n") == len(terms)).groupBy("doc_id").agg(F.count("*").alias("tf"), F.first("length").alias("length")).withColumn("term", F.lit("phrase"))
    else:
        counts = hits.groupBy("doc_id", "term").agg(F.countDistinct("pos").alias("tf"), F.first("length").alias("length"))
        full = counts.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(set(terms)))
        matched = counts.join(full.select("doc_id"), "doc_id", "left_semi")
    if extent is None:
        extent = index.groupBy("doc_id").agg(F.first("length").alias("length")).agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    df = matched.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = matched.join(df, "term").crossJoin(F.broadcast(extent)).groupBy("doc_id").agg(F.sum(part).alias("score"))  # one row
    ordered = scored.orderBy(F.col("score").desc(), "doc_id")
    return ordered if k is None else ordered.limit(k)


def search_texts(documents: DataFrame, query: str, *, phrase: bool = True, k: int | None = 20, doc_id: str = "id", text: str = "text") -> DataFrame:
    """``search`` without an index: one pass for the query's words and one for the texts' lengths."""
    terms = _terms(query)
    return search(postings(documents, doc_id=doc_id, text=text, terms=sorted(set(terms))), query, phrase=phrase, k=k, extent=_extent(documents, doc_id, text))


def snippet(text, term: str, around: int = 100):
    """Column: the text about the first place of a term, or its first 200 characters."""
    at = F.locate(term.lower(), F.lower(text))
    begin = F.greatest(at - around, F.lit(1))
    cut = F.substr(text, begin, F.lit(len(term) + 2 * around))
    return F.when(at > 0, F.concat(F.when(begin > 1, "...").otherwise(""), cut, F.when(begin + len(term) + 2 * around <= F.length(text), "...").otherwise(""))).otherwise(F.substring(text, 1, 200))
