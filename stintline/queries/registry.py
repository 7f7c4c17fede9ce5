"""Registration of queries: a name, the DataFrame job, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stintline.fixtures import Fixture, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a job over a Fixture; `sql` is its statement over the fixture views (without them)."""

    def register(job: Callable[[Fixture], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: job(Fixture(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return job

    return register
