"""Queries: streaming jobs run over the given tables, and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import fingerprint as fp
from palimpsest.plans.catalog import Tables, query
from palimpsest.plans.inputs import cte, iso, iso_sql, lines, with_
from palimpsest.streaming import jobs as sj


def stream(t: Tables, name: str) -> DataFrame:
    """One of the tables as a file stream."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _drain(q) -> None:
    q.awaitTermination()


# ---- arriving versions --------------------------------------------------------------------------------

@query("st1_arriving_versions")
def _(t: Tables) -> DataFrame:
    """Even documents are the library, twenty to a thread; the odd ones arrive as a stream."""
    even = fp.classes(fp.fingerprints(fp.paragraph_hashes(lines(t).filter("doc_id % 2 = 0"), ["doc_id"]), ["doc_id"]))
    docs = lambda d, added: d.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), F.lit(added).alias("added"), "text")
    library = even.select(F.col("doc_id").alias("id"), F.lit("2026-01-01").alias("added"), F.expr("doc_id div 20").alias("thread"), "fp", "cls")
    base = docs(t.documents.filter("doc_id % 2 = 0"), "2026-01-01").select(
        F.expr("id div 20").alias("thread"), "id", "sha", "added", F.expr("cast(id % 20 div 2 + 1 as int)").alias("n"))
    work = sj.work_folder(t.spark, "arrivals")
    _drain(sj.follow_arrivals(docs(stream(t, "documents").filter("doc_id % 2 = 1"), "2026-01-02"), library, base,
                              f"{work}/store", f"{work}/checkpoint", once=True))
    return sj.read_store(t.spark, f"{work}/store/versions", sj.VERSION).select("thread", "id", "n")


# ---- file changes -------------------------------------------------------------------------------------

def _file_events(e: DataFrame) -> DataFrame:
    """A path per user; the modification time moves on every second."""
    return e.select(F.col("user_id").alias("path"), F.date_trunc("second", "ts").cast("string").alias("mtime"), F.col("ts").alias("at"))


@query("st2_file_changes", f"""SELECT path, mtime FROM (SELECT path, arg_max(mtime, tt) AS mtime FROM (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY tt) AS g FROM (
      SELECT *, CASE WHEN tt - lag(tt) OVER (PARTITION BY path ORDER BY tt) < INTERVAL 700 MILLISECOND THEN 0 ELSE 1 END AS n FROM (
        SELECT user_id AS path, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS mtime, min(ts) AS tt FROM events GROUP BY ALL))) GROUP BY path, g)""")
def _(t: Tables) -> DataFrame:
    return sj.file_changes(_file_events(t.events)).select("path", "mtime")


# ---- decisions ----------------------------------------------------------------------------------------

def _decisions(e: DataFrame) -> DataFrame:
    v = F.when(F.col("event_type") == "purchase", "a").when(F.col("event_type") == "error", "r").when(F.col("event_type") == "view", "h")
    return e.select(F.col("user_id").alias("pair_key"), (F.col("event_id") % 40).alias("change"), v.alias("v"), (F.col("user_id") % 5).alias("by"),
                    iso(F.col("ts")).alias("at"), F.col("event_id").alias("seq"))


@query("st3_decision_log", f"""SELECT user_id AS pair_key, event_id % 40 AS change, arg_max(coalesce(CASE event_type WHEN 'purchase' THEN 'a' WHEN 'error' THEN 'r' WHEN 'view' THEN 'h' END, '-'), (ts, event_id)) AS v,
    max({iso_sql('ts')}) AS "at" FROM events GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    """The log is streamed into a store; the state is read back from it."""
    work = sj.work_folder(t.spark, "decisions")
    _drain(sj.follow_decisions(_decisions(stream(t, "events")), f"{work}/store", f"{work}/checkpoint", once=True))
    got = sj.current_decisions(sj.read_store(t.spark, f"{work}/store", sj.DECISION))
    return got.select("pair_key", "change", F.coalesce("v", F.lit("-")).alias("v"), "at")


# What a stream has given out when its input ends lies before the watermark.
MARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 SECOND FROM events{})"


@query("st5_round_summaries", f"""WITH e AS (SELECT user_id AS pair_key, ts AS tt, event_id % 3 AS decided, event_type AS digest FROM events),
    r AS (SELECT pair_key, max(tt) AS tt, arg_max(decided, (tt, decided, digest)) AS decided, arg_max(digest, (tt, decided, digest)) AS digest
      FROM (SELECT *, sum(n) OVER (PARTITION BY pair_key ORDER BY tt) AS g FROM (
        SELECT *, CASE WHEN tt - lag(tt) OVER (PARTITION BY pair_key ORDER BY tt) < INTERVAL 600 MILLISECOND THEN 0 ELSE 1 END AS n FROM e))
      GROUP BY pair_key, g HAVING max(tt) + INTERVAL 600 MILLISECOND <= {MARK.format('')})
    SELECT pair_key, count(*) AS n FROM (SELECT *, lag(decided) OVER w AS pd, lag(digest) OVER w AS pg FROM r WINDOW w AS (PARTITION BY pair_key ORDER BY tt))
    WHERE pd IS DISTINCT FROM decided OR pg IS DISTINCT FROM digest GROUP BY pair_key""")
def _(t: Tables) -> DataFrame:
    """The edits are streamed; rounds that have settled and differ from the one before are read back."""
    work = sj.work_folder(t.spark, "rounds")
    e = stream(t, "events").select(F.col("user_id").alias("pair_key"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3).alias("decided"), F.col("event_type").alias("digest"))
    _drain(sj.follow_rounds(e, f"{work}/store", f"{work}/checkpoint", once=True))
    return sj.read_store(t.spark, f"{work}/store", sj.ROUND).groupBy("pair_key").agg(F.count("*").alias("n"))


@query("st4_soft_deletes", f"""SELECT d.user_id AS id, d.event_id FROM events d WHERE d.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events u WHERE u.event_type = 'click'
    AND u.user_id = d.user_id AND u.ts >= d.ts AND u.ts <= d.ts + INTERVAL 10 SECOND)
    AND date_trunc('milliseconds', d.ts + INTERVAL 10 SECOND) < {MARK.format(" WHERE event_type IN ('error', 'click')")}""")
def _(t: Tables) -> DataFrame:
    """Errors delete, clicks undo; both are streamed, and a timer decides."""
    e = lambda events, kind: events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    work = sj.work_folder(t.spark, "purges")
    s = stream(t, "events")
    _drain(sj.follow_purges(e(s, "error"), e(s, "click"), f"{work}/store", f"{work}/checkpoint", once=True))
    got = sj.read_store(t.spark, f"{work}/store", "id bigint, deleted_at timestamp").select("id", F.col("deleted_at").alias("at")).distinct()
    return e(t.events, "error").join(got, ["id", "at"], "left_semi").select("id", "event_id")


@query("st6_page_progress", """SELECT user_id AS pair_id, count(*) AS done, count(*) FILTER (value >= 5) AS differing, count(*) FILTER (value < 5 AND event_id % 4 = 0) AS suspects FROM events GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    """Every event is a finished page; counters are streamed in update mode."""
    work = sj.work_folder(t.spark, "progress")
    p = stream(t, "events").select(F.col("user_id").alias("pair_id"), F.when(F.col("value") < 5, 0.0).otherwise(F.col("value")).alias("pct"), (F.col("event_id") % 4 == 0).alias("suspect"))
    _drain(sj.follow_pages(p, f"{work}/store", f"{work}/checkpoint", once=True))
    return sj.latest(sj.read_store(t.spark, f"{work}/store", sj.PROGRESS), ["pair_id"], [F.col("batch")]).drop("batch")


def _log(e: DataFrame) -> DataFrame:
    return e.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("v"))


def _counts(t: Tables, *size: str) -> DataFrame:
    """Counts streamed in update mode; the last state of every window is read back."""
    work = sj.work_folder(t.spark, "counts")
    _drain(sj.follow_counts(_log(stream(t, "events")), size[0], f"{work}/store", f"{work}/checkpoint", *size[1:], once=True))
    return sj.current_counts(sj.read_store(t.spark, f"{work}/store", sj.WINDOW)).withColumn("start", iso(F.col("start")))


@query("st7_daily_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS start, event_type AS v, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return _counts(t, "1 day")


@query("st7_sliding_counts", """SELECT strftime(date_trunc('hour', ts) - k * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS start, event_type AS v, count(*) AS n FROM events, range(3) r(k) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return _counts(t, "3 hours", "1 hour")
