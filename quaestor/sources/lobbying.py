"""Lobbying records as documents: a profile of each registrant and a filing for each foreign principal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a registrant; all but the name may be null.
REGISTRANT = (
    "name string, status string, number string, notes string, principals array<string>, clients array<string>, "
    "foreign_principals array<struct<name: string, country: string, period: string, compensation: string, notes: string>>"
)


def _line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def _text(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _file(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.btrim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), F.lit("_")), F.lit(".txt"))


def documents(registrants: DataFrame) -> DataFrame:
    """(filename, text) of registrants (``REGISTRANT``): profiles, then filings; rows without a name give nothing."""
    r = registrants.filter("name <> ''")
    foreign = F.transform("foreign_principals", lambda p: F.concat_ws("; ", p["name"], p["country"], p["period"], p["compensation"], p["notes"]))
    listed = lambda head, items: F.when(F.size(F.coalesce(items, F.array())) > 0, F.concat(F.lit(f"{head}:\n- "), F.array_join(items, "\n- ")))
    profile = _text(
        F.lit("Lobbying disclosure: registrant"), _line("Registrant", F.col("name")), _line("Status", F.coalesce("status", F.lit("unknown"))), _line("Registration", F.col("number")),
        _line("Principals", F.array_join("principals", ", ")), _line("Notes", F.col("notes")), listed("Foreign principals", foreign), listed("Domestic clients", F.col("clients")),
    )
    filing = r.select("name", F.explode("foreign_principals").alias("p"))
    own = _text(
        F.lit("Lobbying filing: foreign principal"), _line("Registrant", F.col("name")), _line("Foreign principal", F.col("p.name")), _line("Country", F.col("p.country")),
        _line("Period", F.col("p.period")), _line("Compensation", F.col("p.compensation")), _line("Details", F.col("p.notes")),
    )
    return r.select(_file("registrant_", F.col("name")).alias("filename"), profile.alias("text")).unionAll(filing.filter("p.name <> ''").select(_file("filing_", F.concat_ws(" ", "name", "p.name")).alias("filename"), own.alias("text")))


def as_files(registrants: DataFrame) -> DataFrame:
    """The same as files (path, content), for ``operators.ingest.tables``."""
    return documents(registrants).select(F.concat(F.lit("lobbying/"), "filename").alias("path"), F.encode("text", "UTF-8").alias("content"))
