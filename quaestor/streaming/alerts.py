"""Structured Streaming over arriving documents and events: keyword alerts, windowed counts, bursts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quaestor.functions import matcher
from quaestor.sources.store import Store


def keyword_alerts(documents: DataFrame, keywords: list[str], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keyword, hits) of each arriving document and keyword it holds, whatever the case; stateless."""
    words = F.array(*[F.lit(k.lower()) for k in keywords if k])
    low = F.lower(F.col(text))
    found = documents.select(F.col(doc_id).alias("doc_id"), low.alias("low"), F.explode(words).alias("keyword")).filter("contains(low, keyword)")
    hits = ((F.length("low") - F.length(F.replace("low", "keyword", F.lit("")))) / F.length("keyword")).cast("long")
    return found.select("doc_id", "keyword", hits.alias("hits"))


def table_alerts(documents: DataFrame, alerts: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, alert_id, keyword, hits) of documents and the alerts (``alert_id``, ``keyword``) of a table, in one scan however many there are."""
    wanted = alerts.select(F.col("alert_id").cast("string").alias("label"), F.lower("keyword").alias("pattern"))
    found = matcher.claims(documents, wanted, doc_id=doc_id, text=text)
    return found.groupBy(F.col("document_id").alias("doc_id"), F.col("label").alias("alert_id"), F.col("pattern").alias("keyword")).agg(F.count("*").alias("hits"))


def watch(documents: DataFrame, alerts: Store, write: Callable[[DataFrame, int], None], *, doc_id: str = "doc_id", text: str = "text") -> DataStreamWriter:
    """A stream over arriving documents that gives ``write`` the alerts of each micro-batch and its number.

    The table of alerts is read anew for each of them, so that one that is added while the stream runs counts from then on, and
    the plan does not depend on how many there are.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        write(table_alerts(batch, alerts.read(), doc_id=doc_id, text=text), epoch)

    return documents.writeStream.foreachBatch(each)


def windowed_counts(events: DataFrame, *, at: str = "ts", kind: str = "event_type", late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """(start, kind, n) per window, emitted once the watermark passes its end."""
    w = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, length), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "kind", "n")


def first_seen(events: DataFrame, *, at: str = "ts", key: str = "user_id", late: str = "7 days") -> DataFrame:
    """One row per key within the watermark: its state is dropped once the watermark has passed it."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key]).select(F.col(key).alias("key"), F.col(at).alias("at"))


class _Windows(StatefulProcessor):
    """Times of one key that no closed window covers yet, and a timer for the moment at which the first of them is settled."""

    def __init__(self, seconds: float, least: int):
        self.seconds, self.least = seconds, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t double")

    def _closed(self, key: tuple, times: list[float], until: float) -> Iterator[pd.DataFrame]:
        """Windows whose whole length lies before the watermark; what is left stays in the state, and an empty state is dropped."""
        out, k, end = [], 0, 0
        while k < len(times) and times[k] + self.seconds < until:
            end = max(end, k)
            while end < len(times) and times[end] - times[k] <= self.seconds:
                end += 1
            if end - k >= self.least:
                out.append((key[0], times[k], times[end - 1], end - k))
                k = end
            else:
                k += 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if k < len(times):
            self.times.put([(t,) for t in times[k:]])
            self.handle.registerTimer(int((times[k] + self.seconds) * 1000) + 1)
        else:
            self.times.clear()
        yield pd.DataFrame(out, columns=["key", "start", "end", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = [t for (t,) in self.times.get()]
        for frame in rows:
            times += frame["t"].tolist()
        yield from self._closed(key, sorted(times), timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._closed(key, sorted(t for (t,) in self.times.get()), timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def settled_windows(events: DataFrame, *, at: str = "ts", key: str = "key", seconds: int = 3600, least: int = 10, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of greedy windows of each key, as ``operators.anomaly.anchored_windows`` gives them for all rows.

    Events may come ``late`` and in any order.  A window is emitted when the watermark has passed its whole length, by a timer if
    nothing more comes, so the last one comes too; a key without open times has no state.  The session's state store must be
    RocksDB's (``ROCKSDB``).
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late).withColumn("t", F.col("at").cast("double"))
    found = rows.groupBy("key").transformWithStateInPandas(_Windows(seconds, least), "key string, start double, end double, n long", "append", "eventTime")
    return found.select("key", F.timestamp_seconds("start").alias("start"), F.timestamp_seconds("end").alias("end"), "n")


#: Setting of a session that runs ``settled_windows``.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def anchored_windows(events: DataFrame, *, at: str = "ts", key: str = "key", seconds: int = 3600, least: int = 10) -> DataFrame:
    """(key, start, end, n) of greedy windows of each key: each opens at the first event that none before covers.

    A window is emitted when an event beyond it has come; until then the key's state holds the times since the window's start.
    Events may be out of order within a micro-batch; one before the times in the state joins the open window.
    """
    def scan(own, frames, state):
        times = list(state.get[0]) if state.exists else []
        for frame in frames:
            times += frame["t"].tolist()
        times.sort()
        out, k = [], 0
        while k < len(times) and times[-1] - times[k] > seconds:
            end = k
            while times[end + 1] - times[k] <= seconds:
                end += 1
            if end - k + 1 >= least:
                out.append((own[0], times[k], times[end], end - k + 1))
                k = end + 1
            else:
                k += 1
        state.update((times[k:],))
        yield pd.DataFrame(out, columns=["key", "start", "end", "n"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").cast("double").alias("t"))
    found = rows.groupBy("key").applyInPandasWithState(scan, "key string, start double, end double, n long", "times array<double>", "append", "NoTimeout")
    return found.select("key", F.timestamp_seconds("start").alias("start"), F.timestamp_seconds("end").alias("end"), "n")
