"""Streams in several batches with late rows and restarts against the same functions over the whole table."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.streaming import jobs as sj

START = datetime(2026, 1, 1)
EVENT = "id bigint, at timestamp, kind string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def in_batches(spark, folder, batches, follow):
    """Every batch of rows is a file, followed by a stream that is started anew for it."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/in/{n}")
        follow(spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{folder}/in")).awaitTermination()


def test_purges_after_the_time_to_undo(spark, tmp_path):
    """Undos before, at and after the end of the time; undos and deletions that come late, across three restarts."""
    rnd = random.Random(3)
    rows = [(1, at(0), "d"), (1, at(10), "u"), (2, at(0), "d"), (2, at(10.001), "u"), (3, at(5), "d"), (3, at(4), "u"),
            (4, at(1), "d"), (4, at(1), "d"), (4, at(30), "d"), (4, at(31), "u"), (None, at(1), "d"), (5, None, "d")]
    rows += [(rnd.randrange(10, 40), at(rnd.randrange(0, 90_000) / 1000), rnd.choice("ddu")) for _ in range(400)]
    # A row comes up to eight seconds late, that is within the delay of ten.
    rows.sort(key=lambda r: (r[1] or at(0)) + timedelta(seconds=rnd.random() * 8))
    batches = [rows[:140], rows[140:280], rows[280:], [(99, at(500), "u")]]
    part = lambda df, kind: df.filter(F.col("kind") == kind)
    store = str(tmp_path / "store")
    in_batches(spark, str(tmp_path), batches, lambda s: sj.follow_purges(part(s, "d"), part(s, "u"), store, str(tmp_path / "cp"), once=True))
    got = sorted((r.id, r.deleted_at) for r in sj.read_store(spark, store, "id bigint, deleted_at timestamp").collect())
    whole = spark.createDataFrame([r for b in batches for r in b], EVENT)
    table = sorted((r.id, r.deleted_at) for r in sj.purges(part(whole, "d"), part(whole, "u")).collect())
    brute = sorted((i, t) for i, t, k in rows if k == "d" and i and t and not any(
        k2 == "u" and i2 == i and t2 and t <= t2 <= t + timedelta(seconds=10) for i2, t2, k2 in rows))
    assert got == table == brute and (2, at(0)) in got and got.count((4, at(1))) == 2


def test_rounds_and_windows_in_batches(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.randrange(6), at(rnd.randrange(0, 60_000) / 1000), rnd.choice("abc")) for _ in range(500)]
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rnd.random() * 8))
    batches = [rows[:200], rows[200:350], rows[350:], [(99, at(500), "z")]]
    whole = spark.createDataFrame([r for b in batches for r in b], EVENT)
    edits = lambda df: df.select(F.col("id").alias("pair_key"), "at", F.lit(1).cast("long").alias("decided"), F.col("kind").alias("digest"))
    rounds, counts = str(tmp_path / "rounds"), str(tmp_path / "counts")
    in_batches(spark, str(tmp_path / "r"), batches, lambda s: sj.follow_rounds(edits(s), rounds, str(tmp_path / "cp_r"), once=True))
    key = lambda r: (r.pair_key, r.at, r.digest)
    none = sj.read_store(spark, str(tmp_path / "no"), sj.ROUND)
    table = sj.changed_rounds(sj.settled_rounds(edits(whole)), none).filter("pair_key < 99")
    assert sorted(map(key, sj.read_store(spark, rounds, sj.ROUND).collect())) == sorted(map(key, table.collect()))
    log = lambda df: df.select("at", F.col("kind").alias("v"))
    in_batches(spark, str(tmp_path / "c"), batches, lambda s: sj.follow_counts(log(s), "10 seconds", counts, str(tmp_path / "cp_c"), "5 seconds", once=True))
    got = sj.current_counts(sj.read_store(spark, counts, sj.WINDOW)).collect()
    assert sorted((r.start, r.v, r.n) for r in got) == sorted((r.start, r.v, r.n) for r in sj.windowed_counts(log(whole), "10 seconds", "5 seconds").collect())
