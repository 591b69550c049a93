"""Sessions for local runs; on a cluster the session comes from outside."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def session(name: str, cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session whose Python workers find this package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *os.environ.get("PYTHONPATH", "").split(os.pathsep)]))
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
