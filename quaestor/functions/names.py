"""Named entities in texts by gazetteers, titles, capitalised runs and organisation endings, as SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import lexicons as L
from quaestor.functions import matcher
from quaestor.functions.phrases import STOP_WORDS

_WORD = r"\p{Lu}[\p{Ll}\p{M}'’-]+"
PEOPLE = rf"(?:\b(?:{'|'.join(L.TITLES)})\.?\s+)({_WORD}(?:\s+(?:\p{{Lu}}\.\s+)?{_WORD}){{0,2}})"
PAIRS = rf"(?<![\p{{L}}.]\s|[\p{{L}}])({_WORD}\s+(?:\p{{Lu}}\.\s+)?{_WORD})\b"
ORGS = rf"((?:{_WORD}\s+){{1,4}}(?:{'|'.join(L.ORGANISATIONS)}))\b"
DATES = rf"({L.MONTHS}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})"
#: Most entities of a type that a document keeps.
MOST = {"person": 100, "place": 50, "org": 50, "date": 50}


def extract_entities(documents: DataFrame, gazetteers: dict[str, list[str]] | None = None, *, doc_id: str = "id", text: str = "text") -> DataFrame:
    """(document_id, name, type, count), the most frequent of each type, ties by name.

    ``gazetteers`` maps person, place and org to names that count wherever they stand, whatever
    their case; longer names claim a place before shorter ones, and names given in small letters
    are shown with capitals.  A person found by its look alone is left out where it is part of a
    name that the gazetteer of persons has, or a single stop word.
    """
    rows = documents.select(F.col(doc_id).alias("document_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = []
    if gazetteers:
        spark = documents.sparkSession
        listed = {(kind, n.lower()): n for kind, names in gazetteers.items() for n in names if n}
        shown = spark.createDataFrame([(kind, low, capitalised(n)) for (kind, low), n in listed.items()], "label string, pattern string, name string")
        hit = matcher.claims(rows, shown, doc_id="document_id", text="body")
        found.append(hit.join(shown, ["label", "pattern"]).select("document_id", "name", F.col("label").alias("type")))
    for kind, pattern in (("person", PEOPLE), ("org", ORGS), ("date", DATES), ("person", PAIRS)):
        hit = rows.select("document_id", F.explode(F.regexp_extract_all("body", F.lit(pattern), F.lit(1))).alias("raw"))
        found.append(hit.select("document_id", F.regexp_replace("raw", r"\s+", " ").alias("name"), F.lit(kind).alias("type")))
    union = found[0]
    for other in found[1:]:
        union = union.unionAll(other)
    known = {n.lower() for n in (gazetteers or {}).get("person", [])}
    if known:
        shared = documents.sparkSession.sparkContext.broadcast((known, "\n".join(sorted(known))))  # the caller's own list

        @F.pandas_udf("boolean")
        def part_of_known(lows: pd.Series) -> pd.Series:
            names, text = shared.value
            inside = {x: x not in names and x in text for x in lows.dropna().unique()}
            return lows.map(lambda x: inside.get(x, False))

        union = union.filter(~F.when(F.col("type") == "person", part_of_known(F.lower("name"))).otherwise(False))
    union = union.filter(~((F.col("type") == "person") & F.lower("name").isin(STOP_WORDS)))
    ends = "|".join(L.ORGANISATIONS)
    counts = union.filter(~((F.col("type") == "person") & F.col("name").rlike(rf"\b(?:{ends})$"))).groupBy("document_id", "name", "type").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("document_id", "type").orderBy(F.col("count").desc(), "name"))
    most = F.expr("CASE type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in MOST.items()) + " END")
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


#: Names in small letters that are shown in capitals.
ACRONYMS = ["usvi", "fbi", "doj", "sdny", "sec", "faa", "pd"]


def capitalised(name: str) -> str:
    """A name as it is shown: as given if it has capitals, else acronyms and dotted letters in capitals, other words with one."""
    if name != name.lower():
        return name
    return " ".join(w.upper() if w in ACRONYMS or w.endswith(".") and len(w.replace(".", "")) * 2 == len(w) else w.title() for w in name.split(" "))
