"""All plans by name, as queries over a directory of tables and as oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaestor.bindings import Corpus, oracle
from quaestor.plans import documents, entities, events, library, more, routes, texts

PLANS: dict[str, str] = entities.PLANS | documents.PLANS | events.PLANS | texts.PLANS | more.PLANS


def _query(plan: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Corpus(spark, sf_dir).sql(plan)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(plan) for name, plan in PLANS.items()} | library.QUERIES | routes.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: oracle(plan) for name, plan in (PLANS | library.ORACLE | routes.ORACLE).items() if name not in routes.QUERIES or name in routes.ORACLE}
