"""Shared small parts: word patterns, tables, lineage cuts in the shared folder, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import shared_folder as _shared

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one below the warehouse where that is unset."""
    folder = _shared(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage with a written table: column-wise, compressed, and read back as often as wanted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint, for small tables in loops (Spark removes unused ones)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_key(doc_id: Column, digest: Column) -> Column:
    """One key, never null, of a document id (null included) and the digest of its text."""
    return F.concat(digest, F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")))


def rows_of(docs: DataFrame, key: Column, stay: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is in ``stay`` (_key), all columns; of several rows with one key the smallest.

    The columns travel inside one struct, so their names cannot clash with the key's; choosing among repeated rows
    reuses the join's partitioning, hence the texts are shuffled once. Keys are longer than the strings of Spark's planned
    sizes, so they are kept from being broadcast by the hint; the shuffle they then share is needed anyway.
    """
    rows = docs.select(key.alias("_key"), F.struct(*docs.columns).alias("_row"))
    return rows.join(stay.hint("merge"), "_key", "left_semi").groupBy("_key").agg(F.min("_row").alias("_row")).select("_row.*")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (a, b): (node, component), the component being its smallest node.

    Alternating large-star and small-star steps until nothing changes; only tables, never a driver-side graph.
    Minima are combined before the shuffle; the joins on a hub are ordinary joins that AQE may split.
    Null ends and self-links are ignored; nodes without a link to another node are not returned.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    state = checkpoint(edges.where("a is not null and b is not null and a <> b")
                       .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            return state.select(u.alias("node"), v.alias("component")).union(
                state.select(v.alias("node"), v.alias("component")).distinct())
        seen = tuple(mark)
        both = state.union(state.select(v, u))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least(m, u).alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), m.alias("v")).where(u > v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(v > m).select(v.alias("u"), m.alias("v"))
        state = checkpoint(small.union(low.select("u", m.alias("v"))).distinct())
