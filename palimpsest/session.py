"""Session settings for the operators; every one is plain Spark configuration."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Inputs hashed on pair_id serve joins on (pair_id, …) without another shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def builder(app: str = "palimpsest") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return b


def share_partitioning(spark: SparkSession) -> None:
    """Applies the setting by which a join on more keys uses rows that lie hashed on one of them, also in a session of others."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(key, SETTINGS[key])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one below the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back, for what several later steps read: its size is known then."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def until_settled(start: DataFrame, step: Callable[[DataFrame], DataFrame], moved: Callable[[DataFrame], DataFrame],
                  cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Doubles steps until no row of ``moved`` is left, or until more steps were made than there are rows
    (what still moves then moves in a circle)."""
    now, steps, rows = cut(start), 1, None
    while not moved(now).isEmpty():
        rows = now.count() if rows is None else rows
        if steps > rows:
            break
        now, steps = cut(step(now)), 2 * steps
    return now
