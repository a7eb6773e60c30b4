"""Version chains, negotiation rounds, hints from earlier rounds and the stores behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T


# ---- version chains: versions(thread, id, n, sha, …), rounds(thread, a, b, total, decided, updated) ---

def live(items: DataFrame) -> DataFrame:
    return items.filter(F.col("deleted").isNull() & F.col("archived").isNull())


def version_base(versions: DataFrame) -> DataFrame:
    """Every version with the one before it."""
    w = Window.partitionBy("thread").orderBy("n")
    return versions.withColumn("base", F.lag("id").over(w))


def default_pair(versions: DataFrame, last: DataFrame) -> DataFrame:
    """pairs(thread, a, b): the pair used last if both versions still exist, else the two newest."""
    v = versions.select("thread", "id")
    used = last.join(v.withColumnRenamed("id", "a"), ["thread", "a"], "left_semi") \
        .join(v.withColumnRenamed("id", "b"), ["thread", "b"], "left_semi").select("thread", "a", "b")
    w = Window.partitionBy("thread").orderBy(F.col("n").desc())
    two = versions.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy("thread").agg(
        F.max(F.when(F.col("k") == 2, F.col("id"))).alias("a2"), F.max(F.when(F.col("k") == 1, F.col("id"))).alias("b2"))
    return two.join(used, "thread", "left").select(
        "thread", F.coalesce("a", "a2").alias("a"), F.when(F.col("a").isNotNull(), F.col("b")).otherwise(F.col("b2")).alias("b")) \
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def drop_versions(versions: DataFrame, drops: DataFrame) -> DataFrame:
    """Versions after removing the listed ones; threads keep at least two, numbers close up."""
    d = drops.select("thread", "id", F.lit(True).alias("drop"))
    per = Window.partitionBy("thread")
    t = versions.join(d, ["thread", "id"], "left")
    t = t.withColumn("_left", F.count(F.when(F.col("drop").isNull(), 1)).over(per))
    t = t.filter(F.col("drop").isNull() | (F.col("_left") < 2)).drop("drop", "_left")
    return t.withColumn("n", F.row_number().over(Window.partitionBy("thread").orderBy("n")))


def drop_rounds(rounds: DataFrame, versions: DataFrame) -> DataFrame:
    """Rounds whose two versions still exist."""
    v = versions.select("thread", "id")
    return rounds.join(v.withColumnRenamed("id", "a"), ["thread", "a"], "left_semi") \
        .join(v.withColumnRenamed("id", "b"), ["thread", "b"], "left_semi")


def thread_progress(pairs: DataFrame, rounds: DataFrame) -> DataFrame:
    """Of the default pair: finished, or how many changes are left; null without a round."""
    r = rounds.select("thread", "a", "b", "total", "decided")
    return pairs.join(r, ["thread", "a", "b"], "left").select(
        "thread", "a", "b", (F.col("decided") >= F.col("total")).alias("finished"),
        F.when(F.col("decided") < F.col("total"), F.col("total") - F.col("decided")).alias("left"))


def recent_pairs(rounds: DataFrame, versions: DataFrame, k: int = 6) -> DataFrame:
    """The k compared pairs of a thread updated last, as far as their versions exist."""
    w = Window.partitionBy("thread").orderBy(F.col("updated").desc(), "a", "b")
    top = rounds.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return drop_rounds(top, versions)


def pair_in_thread(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """pairs(sha_a, sha_b) that lie in one thread with a before b: thread, a, b."""
    v = lambda s: versions.select("thread", F.col("sha").alias(f"sha_{s}"), F.col("id").alias(s), F.col("n").alias(f"n{s}"))
    return pairs.join(v("a"), "sha_a").join(v("b"), ["thread", "sha_b"]).filter("na < nb") \
        .select("thread", "a", "b", "sha_a", "sha_b")


def new_versions(arrivals: DataFrame, versions: DataFrame) -> DataFrame:
    """Arrivals (thread, id, sha, added) whose content the thread does not hold, numbered onwards."""
    fresh = arrivals.join(versions.select("thread", "sha"), ["thread", "sha"], "left_anti")
    one = Window.partitionBy("thread", "sha").orderBy("added", "id")
    fresh = fresh.withColumn("_k", F.row_number().over(one)).filter("_k = 1").drop("_k")
    top = versions.groupBy("thread").agg(F.max("n").alias("_top"))
    w = Window.partitionBy("thread").orderBy("added", "id")
    return fresh.join(top, "thread", "left").withColumn(
        "n", F.coalesce("_top", F.lit(0)) + F.row_number().over(w)).drop("_top")


def version_labels(versions: DataFrame) -> DataFrame:
    """yyyy-MM for the first of a month, the day for the next, then the day with a counter.

    Labels are given in order of n; a label counts as taken once given.
    """
    month, day = F.date_format("mtime", "yyyy-MM"), F.date_format("mtime", "yyyy-MM-dd")
    v = versions.withColumn("_m", month).withColumn("_d", day)
    in_month = Window.partitionBy("thread", "_m").orderBy("n")
    v = v.withColumn("_first", F.row_number().over(in_month) == 1)
    in_day = Window.partitionBy("thread", "_d").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    k = F.sum((~F.col("_first")).cast("int")).over(in_day)
    return v.withColumn("label", F.when(F.col("_first"), F.col("_m")).when(k == 1, F.col("_d")).otherwise(
        F.concat("_d", F.lit(" ("), k.cast("string"), F.lit(")")))).drop("_m", "_d", "_first")


# ---- hints: items(thread, a, b, ord, clause, before, after, v) of the rounds ---------------------------

def prior_rounds(rounds: DataFrame, versions: DataFrame, target: DataFrame) -> DataFrame:
    """Rounds before the round that ends at ``target`` (thread, b), with age 1 for the latest."""
    n = versions.select("thread", F.col("id").alias("b"), F.col("n").alias("nb"))
    t = target.join(n, ["thread", "b"]).select("thread", F.col("nb").alias("limit"))
    w = Window.partitionBy("thread").orderBy(F.col("nb").desc(), "a")
    return rounds.join(n, ["thread", "b"]).join(t, "thread").filter(F.col("nb") < F.col("limit")) \
        .withColumn("age", F.row_number().over(w)).drop("limit")


def hints(changes: DataFrame, items: DataFrame) -> DataFrame:
    """Adds hint, reuse and hint_age to changes(thread, cid, kind, clause, before, after).

    ``items`` are the decided items of the prior rounds with ``age`` and ``ord``. The same text pair
    rejected before: reverted; decided otherwise: repeat; else the same clause: related. Both lookups
    are reduced to one row per key before the join.
    """
    key = lambda p: F.concat(T.strip_ws(F.col(f"{p}before")), F.lit("\x00"), T.strip_ws(F.col(f"{p}after")))
    done = items.filter(F.col("v").isNotNull()).withColumn("k", key(""))
    # A rejection wins over any other verdict, then the latest round and the first item in it.
    first = F.min(F.struct((F.col("v") != "r").alias("x"), "age", "ord", "v"))
    exact = done.groupBy("thread", "k").agg(first.alias("e"))
    clause = done.filter(F.col("clause").isNotNull() & (F.col("clause") != "")).groupBy("thread", "clause").agg(
        F.min(F.struct("age", "ord")).alias("c"))
    empty = F.col("k") == "\x00"
    open_ = ~F.col("kind").isin("fmt", "move") & ~empty
    hit = F.col("e").isNotNull()
    return changes.withColumn("k", key("")).join(exact, ["thread", "k"], "left").join(clause, ["thread", "clause"], "left") \
        .withColumn("hint", F.when(open_, F.when(hit, F.when(F.col("e.v") == "r", "reverted").otherwise("repeat"))
                                  .when(F.col("c").isNotNull(), "related"))) \
        .withColumn("reuse", F.when(open_ & hit, F.col("e.v"))) \
        .withColumn("hint_age", F.when(open_, F.coalesce("e.age", "c.age"))).drop("k", "e", "c")


def clause_history(items: DataFrame, versions: DataFrame, asked: DataFrame) -> DataFrame:
    """For asked (thread, clause, up_to): the items of that clause in earlier rounds, oldest first."""
    n = lambda c, out: versions.select("thread", F.col("id").alias(c), F.col("n").alias(out))
    q = asked.filter(F.col("clause").isNotNull()).join(n("up_to", "lim"), ["thread", "up_to"])
    w = Window.partitionBy("thread", "clause", "up_to").orderBy("nb", "a", "ord")
    return q.join(items.join(n("b", "nb"), ["thread", "b"]), ["thread", "clause"]).filter("nb < lim") \
        .withColumn("step", F.row_number().over(w)).select("thread", "clause", "up_to", "step", "a", "b", "ord", "v")


# ---- stores -------------------------------------------------------------------------------------------

def dedupe_files(files: DataFrame, order: Column) -> DataFrame:
    """One file per content and extension."""
    w = Window.partitionBy("sha", "ext").orderBy(order)
    return files.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def unreferenced(files: DataFrame, refs: DataFrame, key: list[str]) -> DataFrame:
    return files.join(refs.select(*key), key, "left_anti")


def usage(records: DataFrame, size: str, updated: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")]
    if updated:
        aggs.append(F.min(updated).alias("oldest"))
    return records.agg(*aggs)


def upsert(old: DataFrame, new: DataFrame, key: list[str], updated: str, order: list[Column] | None = None) -> DataFrame:
    """Latest record per key. The top-1 limit is applied before the shuffle, so a hot key costs one
    record per map task."""
    w = Window.partitionBy(*key).orderBy(F.col(updated).desc(), *(order or []))
    return old.unionByName(new).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def import_newer(old: DataFrame, new: DataFrame, key: list[str], updated: str = "updated") -> DataFrame:
    """Records of ``new`` that are missing from ``old`` or newer than it, and the untouched old ones."""
    o = old.select(*key, F.col(updated).alias("_old"))
    take = new.join(o, key, "left").filter(F.col("_old").isNull() | (F.col(updated) > F.col("_old"))).drop("_old")
    return old.join(take.select(*key), key, "left_anti").unionByName(take)


def retain(records: DataFrame, cutoff, updated: str = "updated") -> DataFrame:
    return records.filter(F.coalesce(F.col(updated), F.lit("")) >= F.lit(cutoff))


def recent_list(opened: DataFrame, user: str, at: str, k: int = 12) -> DataFrame:
    """Per user the k pairs of paths opened last, each once."""
    last = opened.groupBy(user, "path_a", "path_b").agg(F.max(at).alias(at))
    w = Window.partitionBy(user).orderBy(F.col(at).desc(), "path_a", "path_b")
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keep_old_items(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Round records to be written: items not supplied are taken from the stored record."""
    o = old.select(*key, F.col("items").alias("_old"))
    return new.join(o, key, "left").withColumn("items", F.coalesce("items", "_old")).drop("_old")


def write_check(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """check(path, code): null when the file may be written, else exists / modified / gone / locked."""
    a = actual.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.col("locked"))
    e = expected.select("path", F.col("mtime").alias("em"), F.col("size").alias("es"))
    here, known = F.col("s").isNotNull(), F.col("es").isNotNull()
    return a.join(e, "path", "full_outer").select("path", (
        F.when(here & ~known, "exists")
        .when(here & known & ((F.abs(F.col("m") - F.col("em")) > 1) | (F.col("s") != F.col("es"))), "modified")
        .when(known & ~here, "gone")
        .when(here & F.coalesce("locked", F.lit(False)), "locked")).alias("code"))
