"""Structured Streaming jobs for arriving versions, file changes, decisions and page progress.

The relational parts are plain DataFrame functions that serve batch and streaming input alike. Stores are
folders with one sub-folder per micro-batch, written by overwrite: a batch repeated after a failure replaces
itself, nothing is rewritten as the store grows, and the current state is the latest record per key.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType, StructType

from palimpsest.operators import fingerprint as fp, library as lib
from palimpsest.session import shared_folder, until_settled, written

DEBOUNCE, ROUND_PAUSE, UNDO = "700 milliseconds", "600 milliseconds", "10 seconds"
UNDO_MICROS = 10_000_000


# ---- stores -------------------------------------------------------------------------------------------

def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def append_batch(df: DataFrame, store: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")


def read_store(spark: SparkSession, store: str, schema: StructType | str) -> DataFrame:
    """All batches of a store, with their ``batch`` number; empty while there are none."""
    try:
        return spark.read.option("basePath", store).schema(_with_batch(schema)).parquet(f"{store}/batch=*")
    except AnalysisException:
        return spark.createDataFrame([], _with_batch(schema))


def _with_batch(schema: StructType | str) -> StructType:
    s = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
    return s.add("batch", IntegerType())


def latest(records: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last record per key; the limit is applied before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return records.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def start(stream: DataFrame, each_batch, checkpoint: str, mode: str = "append", once: bool = False) -> StreamingQuery:
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each_batch)
    return (w.trigger(availableNow=True) if once else w).start()


# ---- arriving versions --------------------------------------------------------------------------------

VERSION = "thread bigint, id bigint, sha string, added string, n int"
# The index: the paragraph sets of all versions, each once with its earliest version, and what paragraphs they hold.
SETS = "cls string, fp array<bigint>, added string, id bigint, thread bigint"
PARAGRAPHS = "h bigint, cls string"
BUCKETS = 64


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def index_rows(fps: DataFrame) -> DataFrame:
    """sets of versions(id, added, thread, fp, cls): of each paragraph set the earliest version."""
    first = fps.groupBy("cls").agg(F.min(F.struct("added", "id", "thread")).alias("m"), F.first("fp").alias("fp"))
    return first.select("cls", "fp", "m.added", "m.id", "m.thread")


def append_index(sets: DataFrame, store: str, batch_id: int) -> None:
    append_batch(sets, f"{store}/sets", batch_id)
    held = sets.select(F.explode("fp").alias("h"), "cls").withColumn("bucket", _bucket(F.col("h")))
    held.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/paragraphs/batch={batch_id}")


def related_sets(hashes: DataFrame, store: str, batch_id: int) -> DataFrame:
    """Sets of earlier batches that hold one of the paragraphs (h) at least. Only the paragraphs' buckets are read."""
    spark = hashes.sparkSession
    held = read_store(spark, f"{store}/paragraphs", StructType.fromDDL(PARAGRAPHS).add("bucket", IntegerType())).filter(F.col("batch") < batch_id)
    asked = hashes.select("h", _bucket(F.col("h")).alias("bucket")).distinct()
    some = held.join(asked, ["bucket", "h"], "left_semi").select("cls").distinct()
    sets = read_store(spark, f"{store}/sets", SETS).filter(F.col("batch") < batch_id).drop("batch")
    return sets.join(some, "cls", "left_semi")


def place_arrivals(arrivals: DataFrame, store: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """(placed(thread, id, sha, added), sets) of arriving documents (id, sha, added, text).

    A document follows the earlier version, of the library or an arrival, that it holds most of (of equal ones the
    earliest); it belongs to the thread of that one. One that follows none begins a thread, named by its id below
    zero. What is earlier is told by (added, id), so the result does not depend on how arrivals fall into batches, as
    long as batches keep that order. ``sets`` are the paragraph sets that are new.
    """
    lines = arrivals.select("id", F.explode(F.split("text", "\n", -1)).alias("line"))
    sized = fp.classes(fp.fingerprints(fp.paragraph_hashes(lines, ["id"]), ["id"]))
    mine = written(arrivals.select("id", "sha", "added").join(sized, "id", "left"))
    docs = written(fp.class_sets(mine.filter("cls is not null")))
    first = mine.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("added", "id")).alias("first"))
    older = written(related_sets(docs.select(F.explode("fp").alias("h")), store, batch_id))
    keys = older.select("cls", F.struct("added", "id").alias("key"), F.col("id").alias("ver_id"))
    # all of the index is earlier than the batch, so its best set is enough; within the batch the order decides
    known = fp.best_matches(docs, older.select("cls", "fp"), keys, 1).join(older.select(F.col("cls").alias("ver_cls"), F.struct("added", "id").alias("first"), "thread"), "ver_cls")
    fresh = fp.match_classes(docs, docs).join(first.withColumnRenamed("cls", "ver_cls"), "ver_cls").withColumn("thread", F.lit(None).cast("long"))
    found = mine.join(known.select("doc_cls", "score", "first", "thread").union(fresh.select("doc_cls", "score", "first", "thread"))
                      .withColumnRenamed("doc_cls", "cls"), "cls").filter(F.col("first") < F.struct("added", "id"))
    parent = found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("first"), "thread")).alias("m"))
    # a thread, or the arrival of this batch to follow
    at = mine.select("id").join(parent, "id", "left").select(
        "id", F.when(F.col("m").isNull(), -F.col("id") - 1).otherwise(F.col("m.thread")).alias("thread"), F.col("m.first.id").alias("up"))

    def step(now: DataFrame) -> DataFrame:
        above = now.select(F.col("id").alias("up"), F.col("thread").alias("_t"), F.col("up").alias("_up"))
        return now.join(above, "up", "left").select("id", F.coalesce("thread", "_t").alias("thread"), F.coalesce("_up", "up").alias("up"))
    settled = until_settled(at, step, lambda now: now.filter("thread is null"), written)
    placed = mine.join(settled.select("id", "thread"), "id")
    new = placed.filter("cls is not null").join(older.select("cls"), "cls", "left_anti")
    return placed.select("thread", "id", "sha", "added"), index_rows(new)


def follow_arrivals(stream: DataFrame, library: DataFrame, base: DataFrame, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends every arriving version to the store and its paragraphs to the index.

    library: id, added, thread, fp, cls of the versions there are; base: them as versions(thread, id, sha, added, n).
    """
    spark = stream.sparkSession
    if read_store(spark, f"{store}/sets", SETS).isEmpty():
        append_index(written(index_rows(library)), store, -1)

    def batch(df: DataFrame, batch_id: int) -> None:
        placed, sets = place_arrivals(df, store, batch_id)
        placed, sets = written(placed), written(sets)
        known = read_store(df.sparkSession, f"{store}/versions", VERSION).filter(F.col("batch") < batch_id).drop("batch")
        theirs = base.unionByName(known).join(placed.select("thread").distinct(), "thread", "left_semi")
        append_index(sets, store, batch_id)
        append_batch(lib.new_versions(placed, theirs).select("thread", "id", "sha", "added", F.col("n").cast("int").alias("n")), f"{store}/versions", batch_id)

    return start(stream, batch, checkpoint, once=once)


# ---- file changes -------------------------------------------------------------------------------------

def file_changes(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """changed(path, mtime, first_at, last_at): one report per burst of events of a path, with pauses below
    700 ms, and only for a new modification time. events: path, mtime, at."""
    if events.isStreaming:
        events = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["path", "mtime"])
    else:
        events = events.groupBy("path", "mtime").agg(F.min("at").alias("at"))
    g = events.groupBy(F.session_window("at", DEBOUNCE).alias("w"), "path").agg(F.max_by("mtime", "at").alias("mtime"))
    return g.select("path", "mtime", F.col("w.start").alias("first_at"), F.col("w.end").alias("closed_at"))


# ---- decisions and rounds -----------------------------------------------------------------------------

DECISION = "pair_key bigint, change bigint, v string, by bigint, at string, seq bigint"
_NEWEST = ["at", "seq"]


def current_decisions(log: DataFrame) -> DataFrame:
    """Only the last write of a change counts, by its own time; late older ones lose."""
    return latest(log, ["pair_key", "change"], [F.col(c) for c in _NEWEST])


def follow_decisions(stream: DataFrame, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the last decision per change of every batch; ``current_decisions`` of the store is the state."""
    def batch(df: DataFrame, batch_id: int) -> None:
        append_batch(current_decisions(df), store, batch_id)

    return start(stream, batch, checkpoint, once=once)


ROUND = "pair_key bigint, at timestamp, decided bigint, digest string"


def settled_rounds(edits: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """rounds(pair_key, at, decided, digest): the summary after a pause of 600 ms in a pair's edits.
    edits: pair_key, at, decided, digest."""
    if edits.isStreaming:
        edits = edits.withWatermark("at", delay)
    g = edits.groupBy(F.session_window("at", ROUND_PAUSE).alias("w"), "pair_key").agg(
        F.max(F.struct("at", "decided", "digest")).alias("m"))
    return g.select("pair_key", F.col("m.at").alias("at"), F.col("m.decided").alias("decided"), F.col("m.digest").alias("digest"))


def changed_rounds(rounds: DataFrame, stored: DataFrame) -> DataFrame:
    """Rounds that differ from the one before them: the previous in the batch, else the stored one."""
    w = Window.partitionBy("pair_key").orderBy("at")
    last = latest(stored.select("pair_key", "at", "decided", "digest"), ["pair_key"], [F.col("at")]) \
        .select("pair_key", F.struct("decided", "digest").alias("_old"))
    t = rounds.join(last, "pair_key", "left").withColumn("_prev", F.coalesce(F.lag(F.struct("decided", "digest")).over(w), "_old"))
    return t.filter(~F.struct("decided", "digest").eqNullSafe(F.col("_prev"))).drop("_prev", "_old")


def follow_rounds(stream: DataFrame, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    def batch(df: DataFrame, batch_id: int) -> None:
        old = read_store(df.sparkSession, store, ROUND).filter(F.col("batch") < batch_id).drop("batch")
        append_batch(changed_rounds(df, old), store, batch_id)

    return start(settled_rounds(stream), batch, checkpoint, once=once)


# ---- soft deletes -------------------------------------------------------------------------------------

def purges(deletes: DataFrame, undos: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """purges(id, deleted_at): deletions not undone within ten seconds, from tables or from streams.

    On streams a timer per id waits until the watermark has passed the end of the time to undo; only then is a
    deletion given out, once. The state of an id is its waiting deletions, and the undos that a deletion still
    under way could meet. Rows without id or time are left out; rows later than the watermark come too late.
    """
    d = deletes.select("id", "at").dropna()
    u = undos.select("id", "at").dropna()
    if not d.isStreaming:
        d, u = d.select("id", F.col("at").alias("deleted_at")), u.select(F.col("id").alias("_id"), F.col("at").alias("_undone_at"))
        within = (F.col("id") == F.col("_id")) & (F.col("_undone_at") >= F.col("deleted_at")) & \
            (F.col("_undone_at") <= F.col("deleted_at") + F.expr(f"INTERVAL {UNDO}"))
        return d.join(u, within, "left_anti")
    both = d.withColumn("undo", F.lit(False)).unionByName(u.withColumn("undo", F.lit(True))) \
        .withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    wait = UNDO_MICROS

    def settle(key, batches, state):
        import pandas as pd

        waiting, undone = (list(x) for x in state.get) if state.exists else ([], [])
        if not state.hasTimedOut:
            for batch in batches:
                undone += batch.us[batch.undo].tolist()
                waiting += batch.us[~batch.undo].tolist()
        waiting = [w for w in waiting if not any(w <= x <= w + wait for x in undone)]
        now = state.getCurrentWatermarkMs()
        over = lambda us: us // 1000 < now
        gone, waiting = [w for w in waiting if over(w + wait)], [w for w in waiting if not over(w + wait)]
        undone = [x for x in undone if not over(x)]
        if waiting or undone:
            state.update((waiting, undone))
            # A timer lies after the watermark.
            state.setTimeoutTimestamp(max(min([w + wait for w in waiting] + undone) // 1000, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"id": [key[0]] * len(gone), "us": gone})

    kind = d.schema["id"].dataType.simpleString()
    got = both.groupBy("id").applyInPandasWithState(
        settle, f"id {kind}, us bigint", "waiting array<bigint>, undone array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return got.select("id", F.timestamp_micros("us").alias("deleted_at"))


def follow_purges(deletes: DataFrame, undos: DataFrame, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends what has to be purged to the store."""
    def batch(df: DataFrame, batch_id: int) -> None:
        append_batch(df, store, batch_id)

    return start(purges(deletes, undos), batch, checkpoint, once=once)


# ---- counters -----------------------------------------------------------------------------------------

def page_progress(pages: DataFrame) -> DataFrame:
    """Per pair: pages done, differing, suspect. pages: pair_id, pct, suspect."""
    same = F.col("pct") < 0.001
    return pages.groupBy("pair_id").agg(F.count("*").alias("done"), F.count_if(~same).alias("differing"),
                                        F.count_if(same & F.col("suspect")).alias("suspects"))


PROGRESS = "pair_id bigint, done bigint, differing bigint, suspects bigint"


def follow_pages(stream: DataFrame, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the counters that changed in a batch; the last batch of a pair is its state."""
    def batch(df: DataFrame, batch_id: int) -> None:
        append_batch(df, store, batch_id)

    return start(page_progress(stream), batch, checkpoint, mode="update", once=once)


def windowed_counts(log: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per verdict in tumbling or sliding windows of event time. log: at, v."""
    if log.isStreaming:
        log = log.withWatermark("at", delay)
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return log.groupBy(w.alias("w"), "v").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "v", "n")


WINDOW = "start timestamp, v string, n bigint"


def follow_counts(stream: DataFrame, size: str, store: str, checkpoint: str, slide: str | None = None, once: bool = False) -> StreamingQuery:
    """Writes the windows whose counts changed in a batch; the last batch of a window is its state."""
    def batch(df: DataFrame, batch_id: int) -> None:
        append_batch(df, store, batch_id)

    return start(windowed_counts(stream, size, slide), batch, checkpoint, mode="update", once=once)


def current_counts(store: DataFrame) -> DataFrame:
    return latest(store, ["start", "v"], [F.col("batch")]).drop("batch")
