"""Streams with timers and with a table of alerts."""

import random

from pyspark.sql import functions as F

from quaestor.operators import anomaly
from quaestor.sources.store import Store
from quaestor.streaming import alerts


def test_windows_settled_by_timers_equal_the_batch(spark, tmp_path):
    rng = random.Random(9)
    spark.conf.set(*alerts.ROCKSDB)
    times = sorted(rng.randrange(4000) for _ in range(120))
    events = [(rng.choice("xy"), t) for t in times] + [("z", 10), ("z", 11), ("z", 12)]
    parts = [[], [], []]
    for key, t in events:
        place = min(2, t // 1400)
        parts[max(0, place - (rng.random() < 0.2))].append((key, t))  # some come late, within the watermark
    parts.append([("end", 40_000)])  # moves the watermark past all others
    parts.append([("end", 40_001)])
    for k, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, "key string, t long").select("key", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    rows = spark.readStream.schema("key string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = alerts.settled_windows(rows, seconds=60, least=3, late="2000 seconds")
    query = found.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.key, r.start, r.end, r.n) for r in spark.table("settled").collect())
    want = []
    for key in "xyz":
        own = spark.createDataFrame([(t,) for k, t in events if k == key], "t long").select(F.timestamp_seconds("t").alias("ts"))
        want += [(key, r.start, r.end, r.n) for r in anomaly.anchored_windows(own, "ts", 60, 3).collect()]
    assert got == sorted(want) and {k for k, *_ in got} == {"x", "y", "z"}  # the last windows too, though nothing came after them
    state = spark.read.format("statestore").option("path", f"{tmp_path}/at").option("stateVarName", "times").load()
    assert {r.k[0] for r in state.select(F.col("key").alias("k")).collect()} <= {"end"}


def test_an_alert_added_between_micro_batches_counts_from_then_on(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/alerts", "alert_id string, keyword string")
    store.append(spark.createDataFrame([("a", "Wire")], store.schema))
    seen = {}

    def write(found, epoch):
        seen[epoch] = sorted((r.doc_id, r.alert_id, r.hits) for r in found.collect())
        if epoch == 0:
            store.append(spark.createDataFrame([("b", "cash"), ("c", "wire")], store.schema))

    for k, rows in enumerate([[(1, "a wire, a WIRE and cash")], [(2, "Cash by wire"), (3, "nothing")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    rows = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    alerts.watch(rows, store, write).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert seen == {0: [(1, "a", 2)], 1: [(2, "a", 1), (2, "b", 1), (2, "c", 1)]}
