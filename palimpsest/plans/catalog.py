"""The registry of queries: each is a function of the tables, most with an SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from palimpsest.session import share_partitioning

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


class Tables:
    """The given parquet tables of one directory, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Dealt(Tables):
    """The tables with their documents dealt by id before they are cut: what later works by document, line or token
    finds its rows together, so texts are shuffled once and their tokens never.

    Tokens take far more room than the text they come from, so the parts are small and their number grows with the input.
    Joins on the id and more keys leave dealt rows where they are; for that a setting of this library is applied to the session.
    """

    PARTS = 16  # per split of the file

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        share_partitioning(spark)

    @cached_property
    def _docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/documents.parquet")

    @cached_property
    def parts(self) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.PARTS * self._docs.rdd.getNumPartitions())

    @cached_property
    def documents(self) -> DataFrame:
        return self.deal(self._docs.select("doc_id", "text"), "doc_id")

    def deal(self, df: DataFrame, key: str) -> DataFrame:
        """Rows dealt by a key as the documents are by their id."""
        return df.repartition(self.parts, key)


def dealt(t: Tables) -> Dealt:
    return t if isinstance(t, Dealt) else Dealt(t.spark, t.folder)


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under an operator name; ``sql`` is its equivalent on the same tables."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add
