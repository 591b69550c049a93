"""JSON of any shape as VARIANT: its leaves by path, and what differs between two snapshots of the same things.

Nested values are opened level by level, each level a join with ``variant_explode``, until none is left; empty objects and lists
are leaves.  What is no JSON has one leaf at the root, the text itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators.graph import cut


def leaves(table: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """(key, path, value): each value that holds no other, as JSON text; null texts have none."""
    spark = table.sparkSession
    rows = table.select(F.col(key).alias("key"), F.col(json).cast("string").alias("json")).filter("json IS NOT NULL")
    rows = rows.select("key", F.lit("$").alias("path"), F.expr("coalesce(try_parse_json(json), parse_json(to_json(named_struct('x', json))))").alias("v"), F.expr("try_parse_json(json) IS NULL").alias("raw"))
    out = rows.filter("raw").select("key", "path", F.expr("to_json(variant_get(v, '$.x', 'variant'))").alias("value"))
    level = cut(rows.filter("NOT raw").drop("raw"))
    while True:
        nested = "size_of > 0"
        sized = level.withColumn("size_of", F.expr(f"CASE WHEN schema_of_variant(v) RLIKE '^(OBJECT|ARRAY)' AND to_json(v) NOT IN ('{{}}', '[]') THEN 1 ELSE 0 END"))
        out = out.unionAll(sized.filter(f"NOT ({nested})").select("key", "path", F.expr("to_json(v)").alias("value")))
        deeper = sized.filter(nested).drop("size_of")
        if deeper.isEmpty():
            return out
        deeper.createOrReplaceTempView("quaestor_nested")
        level = cut(spark.sql("SELECT n.key, CASE WHEN x.key IS NULL THEN concat(n.path, '[', x.pos, ']') ELSE concat(n.path, '.', x.key) END AS path, x.value AS v FROM quaestor_nested n, LATERAL variant_explode(n.v) x"))


def difference(before: DataFrame, after: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """(key, path, change, before, after): leaves that were added, removed or changed between two snapshots."""
    a, b = (leaves(t, key, json) for t in (before, after))
    both = a.withColumnRenamed("value", "before").join(b.withColumnRenamed("value", "after"), ["key", "path"], "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.filter("NOT before <=> after").select("key", "path", change.alias("change"), "before", "after")
