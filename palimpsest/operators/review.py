"""Decisions on changes: fingerprints, re-attachment, saving, bulk steps, progress and rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T

BY = ["pair_id"]


def fingerprint_changes(changes: DataFrame) -> DataFrame:
    """Adds ``base`` (section|kind|before|after) and ``fp`` (base#k for its k-th occurrence)."""
    base = F.concat_ws("|", F.coalesce("sec", F.lit("body")), "kind", T.squeeze(F.col("before")), T.squeeze(F.col("after")))
    w = Window.partitionBy("pair_id", "base").orderBy("cid")
    return changes.withColumn("base", base).withColumn(
        "fp", F.concat("base", F.lit("#"), F.row_number().over(w).cast("string")))


def attach_decisions(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Fingerprinted changes with their saved decision: v, by, at, note (null when none fits).

    ``decisions``: pair_id, fp, v, by, at, note, has_clause, clause, stale. A decision that recorded a
    clause only fits a change of the same clause.
    """
    d = decisions.filter(F.col("stale").isNull()).select(
        "pair_id", "fp", "v", "by", "at", "note", "has_clause", F.col("clause").alias("_cl"))
    j = changes.join(d, ["pair_id", "fp"], "left")
    fits = ~F.coalesce("has_clause", F.lit(False)) | F.col("_cl").eqNullSafe(F.col("clause"))
    for c in ("v", "by", "at", "note"):
        j = j.withColumn(c, F.when(fits, F.col(c)))
    return j.withColumn("attached", F.col("has_clause").isNotNull() & fits).drop("has_clause", "_cl")


def lost_decisions(decisions: DataFrame, attached: DataFrame) -> DataFrame:
    """Saved verdicts that no change of the current result took up."""
    used = attached.filter("attached").select("pair_id", "fp")
    return decisions.filter(F.col("v").isNotNull() & F.col("stale").isNull()).join(used, ["pair_id", "fp"], "left_anti")


def upgrade_decisions(changes: DataFrame, decisions: DataFrame, version: int) -> DataFrame:
    """Decisions after a change of paragraph reading: pair_id, fp, kept, stale.

    A record without a clause is taken up only if its base occurs once among the changes and once among
    the live records; verdicts not taken up become stale.
    """
    base = F.regexp_replace("fp", r"#\d+$", "")
    live = decisions.filter(F.col("stale").isNull())
    rec = live.withColumn("base", base).withColumn("rn", F.count("*").over(Window.partitionBy("pair_id", "base")))
    cur = changes.select("pair_id", "fp", "base", "clause", F.lit(True).alias("here")).withColumn(
        "cn", F.count("*").over(Window.partitionBy("pair_id", "base"))).drop("base").withColumnRenamed("clause", "cur_clause")
    j = rec.join(cur, ["pair_id", "fp"], "left")
    fits = F.when(F.col("has_clause"), F.col("clause").eqNullSafe(F.col("cur_clause"))) \
        .otherwise((F.col("rn") == 1) & (F.col("cn") == 1))
    kept = F.coalesce(F.col("here") & fits, F.lit(False))
    return j.select("pair_id", "fp", "v", kept.alias("kept"),
                    F.when(~kept & F.col("v").isNotNull(), version).alias("stale"))


def save_decisions(changes: DataFrame, current: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored records after saving the current decisions (pair_id, cid, v, by, at, note).

    A decided or noted change replaces the record of its fingerprint; records of changes not in the
    result stay; a cleared change deletes its record only if the clause fits and it is not stale.
    """
    now = changes.select("pair_id", "cid", "fp", F.col("clause").alias("cur_clause")).join(current, ["pair_id", "cid"], "left") \
        .select("pair_id", "fp", "cur_clause", F.col("v").alias("nv"), F.col("by").alias("nby"), F.col("at").alias("nat"),
                F.col("note").alias("nnote"), F.lit(True).alias("here"))
    j = now.join(stored, ["pair_id", "fp"], "full_outer")
    here = F.coalesce("here", F.lit(False))
    put = here & (F.col("nv").isNotNull() | (F.coalesce("nnote", F.lit("")) != ""))
    old = F.col("has_clause").isNotNull()
    fits = ~F.coalesce("has_clause", F.lit(False)) | F.col("clause").eqNullSafe(F.col("cur_clause"))
    cleared = here & ~put & old & F.col("stale").isNull() & fits
    new = lambda n, o: F.when(put, F.col(n)).otherwise(F.col(o)).alias(o)
    return j.filter(put | (old & ~cleared)).select(
        "pair_id", "fp", new("nv", "v"), new("nby", "by"), new("nat", "at"), new("nnote", "note"),
        F.when(put, True).otherwise(F.col("has_clause")).alias("has_clause"), new("cur_clause", "clause"),
        F.when(put, F.lit(None)).otherwise(F.col("stale")).alias("stale"))


def carry_over(own: DataFrame, predecessor: DataFrame, prior: DataFrame) -> DataFrame:
    """Decisions of a pair; where it has none, those of the pair it replaced (pair_id, prev_pair)."""
    none = predecessor.join(own.select("pair_id"), "pair_id", "left_anti")
    moved = none.join(prior.withColumnRenamed("pair_id", "prev_pair"), "prev_pair").drop("prev_pair")
    return own.unionByName(moved.select(*own.columns))


# ---- bulk steps ---------------------------------------------------------------------------------------

def decide_all(dec: DataFrame, verdict: str | None, reviewer: str, at: Column, only_pending: bool = False) -> DataFrame:
    """Decisions after a bulk verdict; None resets the verdicts and keeps the notes."""
    if verdict is None:
        return dec.withColumn("v", F.lit(None).cast("string"))
    hit = F.col("v").isNull() if only_pending else F.lit(True)
    return dec.withColumn("by", F.when(hit, F.lit(reviewer)).otherwise(F.col("by"))) \
        .withColumn("at", F.when(hit, at).otherwise(F.col("at"))) \
        .withColumn("v", F.when(hit, F.lit(verdict)).otherwise(F.col("v")))


def bulk_impact(dec: DataFrame, kind: str, by: list[str] = BY) -> DataFrame:
    """What a bulk step ('a', 'r' or 'reset') would do: total, overwrite, clear, same."""
    has = F.col("v").isNotNull()
    zero = F.lit(0).cast("long")
    n = F.count_if(has)
    same = F.count_if(has & (F.col("v") == kind))
    over, clear, eq = (zero, n, zero) if kind == "reset" else (n - same, zero, same)
    return dec.groupBy(*by).agg(F.count("*").alias("total"), over.alias("overwrite"), clear.alias("clear"), eq.alias("same"))


def set_note(dec: DataFrame, notes: DataFrame, reviewer: str, key: list[str]) -> DataFrame:
    """Decisions after writing notes (key…, new_note, at_new): author and time of a decision stay; a
    record with neither verdict nor note goes."""
    j = dec.join(notes, key, "full_outer")
    wrote = F.col("new_note").isNotNull()
    note = F.when(wrote, F.when(F.col("new_note") != "", F.col("new_note"))).otherwise(F.col("note"))
    out = j.select(*key, "v", F.coalesce("by", F.lit(reviewer)).alias("by"), F.coalesce("at", "at_new").alias("at"), note.alias("note"))
    return out.filter(F.col("v").isNotNull() | F.col("note").isNotNull())


def reuse_verdicts(hinted: DataFrame) -> DataFrame:
    """Takes the verdict of a reverted or repeated change over where none was given."""
    take = F.col("v").isNull() & F.col("reuse").isNotNull()
    return hinted.withColumn("reused", take).withColumn("v", F.coalesce("v", "reuse"))


def undo(dec: DataFrame, selected: DataFrame, by: list[str] = BY) -> DataFrame:
    """Decisions after one undo per pair: the selected change (by…, cid) if it is decided, else the one
    decided last. The note stays; a record without one goes."""
    has = F.col("v").isNotNull()
    last = dec.filter(has).groupBy(*by).agg(F.max(F.struct("at", "cid"))["cid"].alias("_last"))
    pick = dec.filter(has).join(selected.select(*by, "cid"), [*by, "cid"], "left_semi") \
        .groupBy(*by).agg(F.max("cid").alias("_sel"))
    j = dec.join(last, by, "left").join(pick, by, "left")
    hit = F.coalesce(F.col("cid") == F.coalesce("_sel", "_last"), F.lit(False))
    return j.filter(~hit | F.col("note").isNotNull()).withColumn("v", F.when(~hit, F.col("v"))).drop("_last", "_sel")


# ---- progress -----------------------------------------------------------------------------------------

def progress(dec: DataFrame, by: list[str] = BY) -> DataFrame:
    """Review progress: total, decided, per verdict, reviewers (distinct, sorted)."""
    n = lambda v: F.count_if(F.col("v") == v)
    return dec.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("v").isNotNull()).alias("decided"), n("a").alias("accepted"),
        n("r").alias("rejected"), n("h").alias("on_hold"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("v").isNotNull(), F.col("by").cast("string")))), ",").alias("reviewers"))


def next_undecided(dec: DataFrame, by: list[str] = BY) -> DataFrame:
    """Adds ``next``: the next change without a verdict, wrapping to the first one of the pair."""
    w = Window.partitionBy(*by).orderBy("cid").rowsBetween(1, Window.unboundedFollowing)
    open_ = F.when(F.col("v").isNull(), F.col("cid"))
    first = F.min(open_).over(Window.partitionBy(*by))
    return dec.withColumn("next", F.coalesce(F.first(open_, ignorenulls=True).over(w), first))


def round_items(changes: DataFrame, dec: DataFrame, key: list[str]) -> DataFrame:
    """Items of a round: changes with a verdict or a note, with their whole texts."""
    d = dec.filter(F.col("v").isNotNull() | (F.coalesce("note", F.lit("")) != "")).select(*key, "v", "note")
    return changes.join(d, key).select(
        *key, "clause", "before", "after", "v", "note")
