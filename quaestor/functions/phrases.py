"""Titles, keywords, repeated phrases and code words of texts, as DataFrame functions of (id, text)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import lexicons as L

#: Words that are no keywords.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is was were are be been being have has had do does did will would could should may might shall can that this these those it its he she they we you "
    "his her their our your my him them us not no nor as if then than so up out about into through during before after above below between same each every all both few more most other some such only own "
    "just also very often here there when where why how what which who whom whose any many much over under again further once said one two three four five first second third new old see page document "
    "file exhibit yes no q a mr ms mrs dr re cc per via i me we don doesn didn won wouldn couldn shouldn isn aren wasn weren hadn hasn haven"
).split()
#: Ordinary words that are suspicious in quotation marks, and words that never are.
COMMON_WORDS = "food dinner lunch breakfast party meeting game play fun trip visit friend help work job business deal trade exchange gift present favor service ticket pass green white snow ice rock sugar candy chocolate coffee tea".split()
UNQUOTED = "said told asked the and but".split()


def _set(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _words(least: int) -> str:
    """Words of ``least`` letters a to z and no other letter or digit; what counts as a letter is that of any script."""
    return rf"filter(regexp_extract_all(lower(text), r'[\p{{L}}\p{{N}}_]+', 0), w -> w RLIKE '^[a-z]{{{least},}}$')"


def title(text: Column, filename: Column) -> Column:
    """The first of the first ten lines with 11 to 79 characters that is no page mark or heading, else the file's name in words."""
    lines = F.transform(F.slice(F.split(F.btrim(text, F.lit(" \t\n\r\f")), "\n"), 1, 10), lambda x: F.btrim(x, F.lit(" \t\n\r\f")))
    fits = F.filter(lines, lambda x: (F.length(x) > 10) & (F.length(x) < 80) & ~F.rlike(x, F.lit("^([pP]age|#)")))
    stem = F.regexp_replace(F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""), "[_-]", " ")
    runs = F.transform(F.regexp_extract_all(stem, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.when(filename != "", F.array_join(runs, "")), F.lit("Untitled"))


def _most(words: DataFrame, sizes: tuple[int, ...], least: int, k: int) -> DataFrame:
    """(id, n, phrase, count, place): the ``k`` most frequent runs of a number of ``words`` (id, ws) of each id that come ``least`` times; ties shorter first, then as they come.

    A text is counted where it is read, and only its first runs leave the task.  Rows that share an id are one text:
    their runs alone are counted by a shuffle.
    """

    @F.udf("array<struct<n: int, phrase: string, count: long>>", useArrow=False)
    def counted(text: str) -> list[tuple[int, str, int]]:
        ws, found = text.split(" ") if text else [], []
        for n in sizes:  # equal counts stay in this order
            found += [(n, run, c) for run, c in Counter(zip(*(ws[i:] for i in range(n)))).items() if c >= least]
        return [(n, " ".join(run), c) for n, run, c in sorted(found, key=lambda x: -x[2])[:k]]

    several = words.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("id").alias("other"))
    same = F.col("id").eqNullSafe(F.col("other"))
    alone = words.join(several, same, "left_anti").select("id", F.posexplode(counted(F.array_join("ws", " "))).alias("place", "x"))
    runs = F.expr(f"flatten(transform(array({', '.join(map(str, sizes))}), n -> transform(IF(size(ws) >= n, sequence(1, size(ws) - n + 1), array()), p -> struct(n AS n, p AS at, array_join(slice(ws, p, n), ' ') AS phrase))))")
    counts = words.join(several, same, "left_semi").select("id", F.explode(runs).alias("x")).groupBy("id", "x.n", "x.phrase").agg(F.count("*").alias("count"), F.min("x.at").alias("at")).filter(F.col("count") >= least)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("count").desc(), "n", "at"))
    together = counts.withColumn("place", place).filter(F.col("place") <= k)
    return alone.select("id", "x.n", "x.phrase", "x.count", F.col("place") + 1).toDF("id", "n", "phrase", "count", "place").unionByName(together.select("id", "n", "phrase", "count", "place"))


def keywords(texts: DataFrame, k: int = 50, stops: list[str] = STOP_WORDS) -> DataFrame:
    """(id, word, count, rank): most frequent words of three letters and more, and pairs of them, but for stop words; ties as they come."""
    kept = texts.select("id", F.filter(F.expr(_words(3)), lambda w: ~F.array_contains(_set(stops), w)).alias("ws"))
    return _most(kept, (1, 2), 1, k).select("id", F.col("phrase").alias("word"), "count", F.col("place").alias("rank"))


def repeated_phrases(texts: DataFrame, least: int = 2, k: int = 50, looked_at: int = 200, stops: list[str] = L.PHRASE_STOPS) -> DataFrame:
    """(id, phrase, count, rank): runs of three to five words that a text repeats, with two words or more that are no stop words.

    Of a text's ``looked_at`` most frequent runs the first ``k`` that qualify; ties shorter first, then as they come.
    """
    seen = _most(texts.select("id", F.expr(_words(2)).alias("ws")), (3, 4, 5), least, looked_at)
    telling = F.size(F.filter(F.split("phrase", " "), lambda w: ~F.array_contains(_set(stops), w))) >= 2
    return seen.filter(telling).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("place"))).filter(F.col("rank") <= k).select("id", "phrase", "count", "rank")


def phrase_totals(phrases: DataFrame) -> DataFrame:
    """(phrase, doc_count, total_count) of repeated phrases."""
    return phrases.groupBy("phrase").agg(F.count("*").alias("doc_count"), F.sum("count").alias("total_count"))


def phrase_trends(phrases: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """(phrase, doc_count, total_count, year, n): the ``k`` phrases of most documents, and their documents by year."""
    top = phrase_totals(phrases).orderBy(F.col("doc_count").desc(), "phrase").limit(k)
    kept = phrases.join(F.broadcast(top), "phrase")  # ``k`` rows: what is left meets the documents
    dated = kept.join(docs.filter("date <> ''").select("id", F.substring("date", 1, 4).alias("year")), "id")
    return dated.groupBy("phrase", "doc_count", "total_count", "year").agg(F.count("*").alias("n"))


def codewords(texts: DataFrame, known: list[str] = L.CODEWORDS, common: list[str] = COMMON_WORDS, k: int = 30) -> DataFrame:
    """(id, word, count, note, context, rank): known code words, then known or ordinary words in quotation marks (once each), by count."""
    low = texts.select("id", "text", F.lower("text").alias("low"))
    word = F.explode(F.transform(_set(known), lambda w, p: F.struct(p.alias("at"), w.alias("word"))))
    hits = low.select("id", "low", word.alias("x")).filter(F.contains("low", "x.word"))
    count = F.floor((F.length("low") - F.length(F.replace("low", F.col("x.word"), F.lit("")))) / F.length("x.word"))
    start = F.greatest(F.instr("low", F.col("x.word")) - 50, F.lit(1))
    around = F.substring("low", start, F.instr("low", F.col("x.word")) + F.length("x.word") + 50 - start)
    plain = hits.select("id", F.lit(0).alias("kind"), F.col("x.at").alias("at"), F.col("x.word").alias("word"), count.alias("count"), F.lit("potential codeword").alias("note"), F.concat(F.lit("..."), F.btrim(around), F.lit("...")).alias("context"))
    marks = '["“”]'
    quoted = low.select("id", "text", F.posexplode(F.expr(f"regexp_extract_all(text, r'(?U){marks}(\\w+(?:\\s+\\w+)?){marks}', 1)")).alias("at", "raw"))
    quoted = quoted.withColumn("w", F.lower("raw")).filter((F.length("w") >= 3) & ~F.array_contains(_set(UNQUOTED), F.col("w")) & F.array_contains(_set([*known, *common]), F.col("w")))
    at = F.greatest(F.instr("text", F.col("raw")) - 41, F.lit(1))
    near = F.substring("text", at, F.instr("text", F.col("raw")) + F.length("raw") + 41 - at)
    marked = quoted.select("id", F.lit(1).alias("kind"), "at", F.concat(F.lit('"'), "w", F.lit('"')).alias("word"), F.lit(1).cast("long").alias("count"), F.lit("quoted ordinary word").alias("note"), F.concat(F.lit("..."), F.btrim(near), F.lit("...")).alias("context"))
    first = Window.partitionBy("id", "word").orderBy("kind", "at")
    once = plain.unionByName(marked).withColumn("turn", F.row_number().over(first)).filter("turn = 1")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("count").desc(), "kind", "at"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "word", "count", "note", "context", "rank")


def redacted(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text, n): spans (document_id, start_offset, end_offset), clamped to the text and merged where they overlap, replaced by [REDACTED]."""
    held = spans.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start_offset", "end_offset"))).alias("spans"))
    last = "least(x.end_offset, length(text))"
    fold = (
        f"aggregate(spans, struct(0L AS at, '' AS out), (s, x) -> CASE WHEN x.start_offset < s.at THEN struct(greatest(s.at, {last}) AS at, s.out AS out) "
        f"ELSE struct(greatest({last}, s.at) AS at, concat(s.out, substr(text, s.at + 1, least(x.start_offset, length(text)) - s.at), '[REDACTED]') AS out) END, s -> concat(s.out, substr(text, s.at + 1)))"
    )
    return texts.select("id", "text").join(held, "id").select("id", F.expr(fold).alias("text"), F.size("spans").cast("long").alias("n"))
