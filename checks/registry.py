"""Registry of checked queries: a Spark callable plus, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """Lazy access to the adapter views of one scale factor: `s.v_contacts`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def wide(self, name: str) -> DataFrame:
        """The view over tables spread over all cores: the driver's tables are one row group, hence one scan task, each."""
        return view(self.spark, self.sf_dir, name, self.spark.sparkContext.defaultParallelism)

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, views: str = "", sql: str | None = None):
    """Register `fn(source) -> DataFrame` and its oracle over the listed views."""
    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = duck(views.split(), sql)
        return fn
    return wrap
