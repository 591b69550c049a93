"""Anomaly detectors over events, documents, entities and file metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators.pairs import both_ends, gaps


#: Windows to a span of time.
_SPAN = 4096


def temporal_gaps(events: DataFrame, day: str = "event_date", least: int = 90) -> DataFrame:
    """(from_day, to_day, days, severity): from 180 days medium, from 365 high."""
    return gaps(events, day, least).withColumn("severity", F.when(F.col("days") >= 365, "high").when(F.col("days") >= 180, "medium").otherwise("low"))


def activity_bursts(events: DataFrame, day: str = "event_date", sigmas: float = 2.0) -> DataFrame:
    """(month, n, severity) of months at or above the mean plus ``sigmas`` sample deviations; of three months at least."""
    months = events.select(F.substring(day, 1, 7).alias("month")).filter("length(month) = 7").groupBy("month").agg(F.count("*").alias("n"))
    s = months.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.count("*").alias("k"))
    hit = months.crossJoin(s).filter("k >= 3 AND sd > 0").filter(F.col("n") >= F.col("mean") + sigmas * F.col("sd"))
    return hit.select("month", "n", F.when(F.col("n") >= F.col("mean") + 3 * F.col("sd"), "high").otherwise("medium").alias("severity"))


def page_outliers(documents: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Documents whose page count is at least the mean plus ``sigmas`` sample deviations; of three at least."""
    some = documents.filter("pages > 0")
    s = some.agg(F.avg("pages").alias("mean"), F.stddev_samp("pages").alias("sd"), F.count("*").alias("k"))
    return some.crossJoin(s).filter("k >= 3 AND sd > 0").filter(F.col("pages") >= F.col("mean") + sigmas * F.col("sd")).select("id", "pages")


def anchored_windows(rows: DataFrame, at: str, seconds: int, least: int, within: str | None = None) -> DataFrame:
    """(start, end, n) of greedy windows: each opens at the first row that none before covers.

    Rows of one time are counted first.  Times are dealt to spans of ``_SPAN`` windows; what one span hands to the next, its
    last time and its number of silences, is a row a span, so that only a table of spans is read in one task.  A silence longer
    than the window, over which no window reaches, ends a stretch; a task scans the distinct times of one stretch.
    """
    timed = rows.select((F.col(within) if within else F.lit(0)).alias("g"), F.col(at).cast("timestamp").cast("double").alias("t")).filter("t IS NOT NULL")
    timed = timed.groupBy("g", "t").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("t") / F.lit(float(seconds * _SPAN))))
    spans = timed.groupBy("g", "span").agg(F.max("t").alias("last"))
    order = Window.partitionBy("g").orderBy("span")
    spans = spans.select("g", "span", F.lag("last").over(order).alias("before"))
    inside = Window.partitionBy("g", "span").orderBy("t")
    silent = timed.join(spans, ["g", "span"]).withColumn("new", F.coalesce((F.col("t") - F.coalesce(F.lag("t").over(inside), "before") > seconds).cast("int"), F.lit(1)))
    earlier = silent.groupBy("g", "span").agg(F.sum("new").alias("news")).select("g", "span", F.coalesce(F.sum("news").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    stretch = silent.withColumn("own", F.sum("new").over(inside)).join(earlier, ["g", "span"]).select("g", "t", "n", (F.col("own") + F.col("earlier")).alias("stretch"))

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        times, until = frame["t"].to_numpy(), np.concatenate([[0], np.cumsum(frame["n"].to_numpy())])
        ends, out, k = np.searchsorted(times, times + seconds, "right"), [], 0
        while k < len(times):
            n = int(until[ends[k]] - until[k])
            if n >= least:
                out.append((times[k], times[ends[k] - 1], n))
                k = ends[k]
            else:
                k += 1
        return pd.DataFrame(out, columns=["start", "end", "n"])

    sizes = stretch.groupBy("g", "stretch").agg(F.sum("n").alias("size")).filter(F.col("size") >= least)
    found = stretch.join(sizes, ["g", "stretch"]).select("g", "stretch", "t", "n").groupBy("g", "stretch").applyInPandas(scan, "start double, end double, n long")
    return found.select(F.timestamp_seconds("start").alias("start"), F.timestamp_seconds("end").alias("end"), "n")


def bulk_ingestion(documents: DataFrame, at: str = "ingested_at") -> DataFrame:
    """Hours in which ten documents or more arrived."""
    return anchored_windows(documents, at, 3600, 10)


def creation_clusters(metadata: DataFrame, at: str = "creation_date", seconds: int = 60) -> DataFrame:
    """Minutes in which three files or more were made."""
    return anchored_windows(metadata, at, seconds, 3)


def missing_metadata(documents: DataFrame) -> DataFrame:
    """(id, missing): which of date, source and category are null or empty."""
    lacks = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("date", "source", "category")]
    return documents.select("id", F.array_compact(F.array(*lacks)).alias("missing")).filter("size(missing) > 0")


def isolated(entities: DataFrame, mentions: DataFrame, links: DataFrame, least: int = 10) -> DataFrame:
    """Entities with ``least`` mentions or more and no connection."""
    totals = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.sum("count").alias("mentions")).filter(F.col("mentions") >= least)
    ends = both_ends(links, links.columns[0], links.columns[1]).select(F.col("node").alias("id"))
    return entities.join(totals, "id").join(ends, "id", "left_anti").select("id", "name", "mentions")


def sudden_appearances(event_entities: DataFrame, events: DataFrame, least: int = 5, days: int = 30) -> DataFrame:
    """(entity_id, n, span): ``least`` events or more, on different dates, all within ``days``."""
    e = event_entities.join(events.select(F.col("id").alias("event_id"), F.try_to_date("event_date", "yyyy-MM-dd").alias("d")), "event_id").filter("d IS NOT NULL")
    g = e.groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("d").alias("dates"), F.datediff(F.max("d"), F.min("d")).alias("span"))
    return g.filter((F.col("n") >= least) & (F.col("dates") >= 2) & (F.col("span") <= days)).select("entity_id", "n", F.col("span").cast("long").alias("span"))


def date_inconsistencies(metadata: DataFrame, now: str) -> DataFrame:
    """(document_id, problem, severity): made after modified, dated after ``now``, or more than 20 years apart."""
    made, changed, today = F.try_to_timestamp("creation_date"), F.try_to_timestamp("modification_date"), F.lit(now).cast("timestamp")
    far = F.abs(F.datediff(changed, made)) > 20 * 365
    problem = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("problem"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(problem(made > changed, "created_after_modified", "high"), problem(made > today, "future_creation", "high"), problem(changed > today, "future_modification", "high"), problem(far, "wide_gap", "medium")))
    return metadata.select("document_id", F.explode(found).alias("x")).select("document_id", "x.*")


def metadata_stripping(metadata: DataFrame) -> DataFrame:
    """(document_id, severity): author, creator, producer and title all empty (medium), or the author alone (low)."""
    empty = {c: F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in ("author", "creator", "producer", "title")}
    every = empty["author"] & empty["creator"] & empty["producer"] & empty["title"]
    return metadata.select("document_id", F.when(every, "medium").when(empty["author"], "low").alias("severity")).filter("severity IS NOT NULL")


def producer_inconsistencies(metadata: DataFrame, least: int = 3) -> DataFrame:
    """(author, n, producers): authors with ``least`` producers or more."""
    some = metadata.filter("author <> '' AND producer <> ''").groupBy("author").agg(F.array_sort(F.collect_set("producer")).alias("producers"))
    return some.withColumn("n", F.size("producers").cast("long")).filter(F.col("n") >= least).select("author", "n", "producers")
