"""Small mutable tables over Parquet: every change writes a new version beside the old and then points to it.

Pointers are numbered files; the one with the highest number that is complete counts.  A pointer
is never deleted before a newer one stands, so a reader sees either the old version or the new
one whole, and a crash at any place leaves the old one.  A number can be taken once: of two
writers the later one reads again and repeats its change.  The version before the last stays for
readers under way.  Meant for the workflow tables (notes, tags, watch lists, boards).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, version) of the complete pointers, the last one last; version is empty where a writer stopped half way."""
        folder, out = self.path(self.folder), []
        if self.fs.exists(folder):
            for status in self.fs.listStatus(folder):
                name = status.getPath().getName()
                if name.startswith("current-"):
                    file = self.fs.open(status.getPath())
                    try:
                        line = file.readLine() or ""
                    finally:
                        file.close()
                    out.append((int(name.removeprefix("current-")), line.removesuffix(".") if line.endswith(".") else ""))
        return sorted(out)

    def _current(self) -> str | None:
        return next((version for _, version in reversed(self._pointers()) if version), None)

    def read(self) -> DataFrame:
        return self._at(self._current())

    def _at(self, version: str | None) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{version}") if version else self.spark.createDataFrame([], self.schema)

    def change(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> None:
        for _ in range(tries):
            pointers = self._pointers()
            base = next((version for _, version in reversed(pointers) if version), None)
            number, version = (pointers[-1][0] + 1 if pointers else 1), f"v-{uuid.uuid4().hex}"
            before = self._at(base)
            change(before).select(*before.columns).write.parquet(f"{self.folder}/{version}")
            if self._point(number, version):
                for old, gone in pointers:
                    if gone != base:
                        self.fs.delete(self.path(f"{self.folder}/current-{old}"), False)
                        if gone:
                            self.fs.delete(self.path(f"{self.folder}/{gone}"), True)
                return
            self.fs.delete(self.path(f"{self.folder}/{version}"), True)
        raise RuntimeError(f"{self.folder}: others changed it {tries} times meanwhile")

    def _point(self, number: int, version: str) -> bool:
        """Takes a number for a version; false where another writer has it."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self.fs.create(self.path(f"{self.folder}/current-{number}"), False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        out.writeBytes(f"{version}.")  # the stop tells a whole pointer from one cut short
        out.close()
        return True

    def append(self, rows: DataFrame, unique: list[str] | None = None) -> None:
        """Adds rows; of ``unique`` keys only new ones, the first of each."""

        def change(t: DataFrame) -> DataFrame:
            new = rows.dropDuplicates(unique).join(t.select(*unique), unique, "left_anti") if unique else rows
            return t.unionByName(new.select(*t.columns))

        self.change(change)

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        self.change(lambda t: t.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*t.columns)))

    def update(self, where: Column, values: dict[str, Column]) -> None:
        self.change(lambda t: t.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in t.columns]))

    def delete(self, where: Column) -> None:
        self.change(lambda t: t.filter(~F.coalesce(where, F.lit(False))))
