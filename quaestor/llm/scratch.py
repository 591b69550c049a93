"""Tables written between stages, so that a lost executor never costs more than one stage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a temporary folder of its own; a
    session on a cluster raises, since no folder of one machine can serve all executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    already = spark.sparkContext.getCheckpointDir()
    if already:
        return already.rstrip("/")
    master = spark.sparkContext.master or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quaestor-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Lists of the paths given out while ``settled`` runs, the innermost last.
_GIVEN: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _GIVEN:
        _GIVEN[-1].append(path)
    return path


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` as a Parquet table in the scratch folder, read back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets at most ``rows`` rows travel to Python at once, where the session asks for more: texts are long.

    The setting counts when a plan runs, so it stays; it changes no result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``written`` of what ``build`` makes; the scratch tables made on the way are deleted then, as nothing reads them any more."""
    path = scratch_path(spark, label)
    _GIVEN.append([])
    try:
        df = build()
        df.write.parquet(path)
        schema = df.schema
    finally:
        made = _GIVEN.pop()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for old in made:
        where = jvm.org.apache.hadoop.fs.Path(old)
        where.getFileSystem(conf).delete(where, True)
    return spark.read.schema(schema).parquet(path)
