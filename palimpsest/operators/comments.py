"""Comment threads: roots, owners, anchors in the compared text, groups and lists.

comments(pair_id, side, id, author, date, text, parent, done, from_b, from_c, from_o, to_b, to_c, to_o,
quote, del_text); tokens(pair_id, row, ix, side, block, blk, c, t, sep, psep, op, fmt, cid).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.session import checkpoint, until_settled

PS = ["pair_id", "side"]


# ---- threads ------------------------------------------------------------------------------------------

def comment_roots(comments: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """root(pair_id, side, id, root): the upper end of the reply chain, however long.

    Steps are doubled, so a chain of n replies takes log2(n) keyed joins; ``cut`` ends the lineage between
    them. Comments that reply to each other in a circle have no root (null).
    """
    known = comments.select(*PS, F.col("id").alias("parent"), F.lit(True).alias("known"))
    up = comments.select(*PS, "id", "parent").join(known, [*PS, "parent"], "left").select(
        *PS, "id", F.when(F.col("known"), F.col("parent")).otherwise(F.col("id")).alias("root"))

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        nxt = second.select(*PS, F.col("id").alias("root"), F.col("root").alias("next"))
        return first.join(nxt, [*PS, "root"]).select(*PS, "id", F.col("next").alias("root"))

    tops = up.filter("id = root").select(*PS, F.col("id").alias("root"), F.lit(True).alias("_top"))

    def moved(now: DataFrame) -> DataFrame:
        return now.join(tops, [*PS, "root"], "left_anti")

    settled = until_settled(up, lambda now: then(now, now), moved, cut)
    return settled.join(tops, [*PS, "root"], "left").select(*PS, "id", F.when(F.col("_top"), F.col("root")).alias("root"))


def threads(comments: DataFrame, roots: DataFrame, ours: list[str], reviewer: str, overrides: DataFrame | None = None,
            local_replies: DataFrame | None = None) -> DataFrame:
    """threads(pair_id, side, id, author, owner, internal, resolved, replied, on_deleted, n_replies, …).

    A manual owner override (pair_id, side, id, owner) wins over the list of our members.
    """
    norm = lambda s: "".join(s.split()).lower()
    names = sorted({norm(x) for x in [*ours, reviewer] if x})
    mine = lambda c: T.norm_name(c).isin(names) if names else F.lit(False)
    r = roots.filter("id <> root").join(comments.select(*PS, "id", "author"), [*PS, "id"]) \
        .groupBy(*PS, F.col("root").alias("id")).agg(
            F.count("*").alias("n_replies"), F.bool_or(mine(F.col("author"))).alias("_replied"))
    t = comments.join(roots.filter("id = root").select(*PS, "id"), [*PS, "id"], "left_semi").join(r, [*PS, "id"], "left")
    for extra, name in ((overrides, "owner"), (local_replies, "local")):
        if extra is None:
            t = t.withColumn(f"_{name}", F.lit(None).cast("string"))
        else:
            value = F.col("owner") if name == "owner" else F.lit("y")
            t = t.join(extra.select(*PS, "id", value.alias(f"_{name}")), [*PS, "id"], "left")
    owner = F.coalesce("_owner", F.when(mine(F.col("author")), "ours").otherwise("theirs"))
    t = t.withColumn("owner", owner)
    return t.withColumn("internal", (F.col("side") == "b") & (F.col("owner") == "ours") & (T.norm_name(F.col("author")) != norm(reviewer))) \
        .withColumn("resolved", F.coalesce("done", F.lit(False))) \
        .withColumn("replied", F.coalesce("_replied", F.lit(False)) | F.col("_local").isNotNull()) \
        .withColumn("on_deleted", (F.col("side") == "b") & (F.coalesce("del_text", F.lit("")) != "") & (F.coalesce("quote", F.lit("")) == "")) \
        .withColumn("n_replies", F.coalesce("n_replies", F.lit(0))).drop("_owner", "_local", "_replied")


def reply_order(comments: DataFrame, roots: DataFrame) -> DataFrame:
    """replies(pair_id, side, root, id, step) by date."""
    w = Window.partitionBy(*PS, "root").orderBy(F.coalesce("date", F.lit("")), "id")
    return roots.filter("id <> root").join(comments.select(*PS, "id", "date"), [*PS, "id"]) \
        .select(*PS, "root", "id", F.row_number().over(w).alias("step"))


# ---- anchors ------------------------------------------------------------------------------------------

def token_offsets(tokens: DataFrame) -> DataFrame:
    """Adds s and e, the characters a token covers in its block and cell."""
    w = Window.partitionBy("pair_id", "side", "row", "blk", "c").orderBy("ix")
    size = F.when(F.col("sep") | F.col("psep"), 0).otherwise(F.length("t"))
    t = tokens.withColumn("_n", size).withColumn("e", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("s", F.col("e") - F.col("_n")).drop("_n")


def comment_marks(comments: DataFrame, offsets: DataFrame) -> DataFrame:
    """marks(pair_id, side, id, row, ix, blk, c, s, e, op, fmt, cid): the tokens a comment's range
    touches, clipped to it. An equi-join by block with an interval condition inside the block."""
    far = 1_000_000_000
    r = comments.filter(F.col("from_b").isNotNull() & F.col("to_b").isNotNull()).select(
        *PS, "id", "from_b", "from_c", "from_o", "to_b", "to_c", "to_o",
        F.explode(F.sequence("from_b", "to_b")).alias("block"))
    j = r.join(offsets, [*PS, "block"])
    fc = F.when(F.col("block") == F.col("from_b"), F.col("from_c")).otherwise(0)
    tc = F.when(F.col("block") == F.col("to_b"), F.col("to_c")).otherwise(far)
    lo = F.when((F.col("block") == F.col("from_b")) & (F.col("c") == fc), F.col("from_o")).otherwise(0)
    hi = F.when((F.col("block") == F.col("to_b")) & (F.col("c") == tc), F.col("to_o")).otherwise(far)
    zero = (F.col("from_b") == F.col("to_b")) & (F.col("from_c") == F.col("to_c")) & (F.col("from_o") == F.col("to_o"))
    touch = F.when(zero, (F.col("s") <= lo) & (F.col("e") >= lo)).otherwise((F.col("e") > lo) & (F.col("s") < hi) & (F.col("e") > F.col("s")))
    return j.filter((F.col("c") >= fc) & (F.col("c") <= tc) & touch).select(
        *PS, "id", "row", "ix", "blk", "c", F.greatest("s", lo).alias("s"), F.least("e", hi).alias("e"),
        F.col("s").alias("tok_s"), "op", "fmt", "cid")


def deleted_anchors(comments: DataFrame, offsets_b: DataFrame, deleted: DataFrame) -> DataFrame:
    """Changes a zero-width comment of side b hangs on: deleted tokens at the place it points to.

    ``deleted`` are the a-side-only tokens (pair_id, row, ix, cid); their place is the end of the last
    b-side token before them in the row.
    """
    w = Window.partitionBy("pair_id", "row").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    b = offsets_b.select("pair_id", "row", "ix", "block", "c", "e", F.lit(None).cast("int").alias("cid"))
    null = F.lit(None).cast("int")
    d = deleted.select("pair_id", "row", "ix", null.alias("block"), null.alias("c"), null.alias("e"), "cid")
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    first_block = F.first("block", ignorenulls=True).over(Window.partitionBy("pair_id", "row").orderBy("ix").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    at = b.unionByName(d).select("pair_id", "row", "ix", "cid", F.coalesce(last("block"), first_block).alias("from_b"),
                                 F.coalesce(last("c"), F.lit(0)).alias("from_c"), F.coalesce(last("e"), F.lit(0)).alias("from_o"))
    z = comments.filter((F.col("side") == "b") & (F.col("from_b") == F.col("to_b")) & (F.col("from_c") == F.col("to_c"))
                        & (F.col("from_o") == F.col("to_o")))
    return z.join(at.filter(F.col("cid").isNotNull()), ["pair_id", "from_b", "from_c", "from_o"]) \
        .select("pair_id", "side", "id", "row", "cid").distinct()


def thread_state(marks: DataFrame) -> DataFrame:
    """Per comment: first row, number of changes touched, plain, changed_by_them, gone."""
    eq = (F.col("op") == 0) & F.col("fmt").isNull()
    g = marks.groupBy(*PS, "id").agg(
        F.min("row").alias("row"), F.count_distinct("cid").alias("n_cids"), F.count_if(eq).alias("eq"), F.count_if(~eq).alias("changed"))
    a = F.col("side") == "a"
    return g.select(*PS, "id", "row", "n_cids", (F.col("n_cids") == 0).alias("plain"), (a & (F.col("changed") > 0)).alias("changed_by_them"),
                    (a & (F.col("changed") > 0) & (F.col("eq") == 0)).alias("gone"))


def thread_changes(marks: DataFrame) -> DataFrame:
    """links(pair_id, side, id, cid)."""
    return marks.filter(F.col("cid").isNotNull() & ~((F.col("op") == 0) & F.col("fmt").isNull())).select(*PS, "id", "cid").distinct()


def project_marks(marks: DataFrame, offsets_b: DataFrame) -> DataFrame:
    """Marks of our draft on the same words of the revised text: unchanged tokens only."""
    m = marks.filter((F.col("side") == "a") & (F.col("op") == 0) & F.col("fmt").isNull() & (F.col("e") > F.col("s")))
    q = offsets_b.select("pair_id", "row", "ix", F.col("s").alias("bs"), F.col("blk").alias("b_blk"), F.col("c").alias("b_c"))
    shift = F.col("bs") - F.col("tok_s")
    return m.join(q, ["pair_id", "row", "ix"]).select(
        "pair_id", "id", "row", "ix", F.col("b_blk").alias("blk"), F.col("b_c").alias("c"), (F.col("s") + shift).alias("s"), (F.col("e") + shift).alias("e"))


def opposite_marks(links: DataFrame, offsets: DataFrame) -> DataFrame:
    """The words the other side has in the changes a comment hangs on."""
    other = offsets.filter((F.col("op") != 0) & F.col("cid").isNotNull() & (F.col("e") > F.col("s"))).select(
        "pair_id", F.when(F.col("side") == "a", "b").otherwise("a").alias("side"), "cid", "row", "ix", "blk", "c", "s", "e")
    return links.join(other, [*PS, "cid"]).select(*PS, "id", "cid", "row", "ix", "s", "e")


def highlight_slices(marks: DataFrame, offsets: DataFrame) -> DataFrame:
    """slices(pair_id, side, row, ix, id, s, e): the part of every token a mark covers, counted from the
    token's start. ``marks`` carry row, blk, c, s, e on their side."""
    m = marks.select("pair_id", "side", "id", "row", "blk", "c", F.col("s").alias("ms"), F.col("e").alias("me"))
    o = offsets.filter(F.col("e") > F.col("s")).select("pair_id", "side", "row", "ix", "blk", "c", "s", "e")
    lo, hi = F.greatest("s", "ms"), F.least("e", "me")
    return m.join(o, ["pair_id", "side", "row", "blk", "c"]).filter(hi > lo).select(
        "pair_id", "side", "row", "ix", "id", (lo - F.col("s")).alias("s"), (hi - F.col("s")).alias("e"))


def merge_marks(marks: DataFrame) -> DataFrame:
    """Marks that touch end to start become one."""
    keys = ["pair_id", "side", "id", "row", "blk", "c"]
    w = Window.partitionBy(*keys).orderBy("s")
    t = marks.withColumn("_n", F.when(F.lag("e").over(w) == F.col("s"), 0).otherwise(1))
    t = t.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*keys, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")


def quotes(comments: DataFrame, cells: DataFrame) -> DataFrame:
    """quote(pair_id, side, id, quote) over a range of blocks and cells; cells(pair_id, side, block, c, text)."""
    far = 1_000_000_000
    r = comments.filter(F.col("from_b").isNotNull()).select(*PS, "id", "from_b", "from_c", "from_o", "to_b", "to_c", "to_o",
                                                          F.explode(F.sequence("from_b", "to_b")).alias("block"))
    j = r.join(cells, [*PS, "block"])
    first = (F.col("block") == F.col("from_b")) & (F.col("c") == F.col("from_c"))
    last = (F.col("block") == F.col("to_b")) & (F.col("c") == F.col("to_c"))
    inside = (F.col("c") >= F.when(F.col("block") == F.col("from_b"), F.col("from_c")).otherwise(0)) & \
        (F.col("c") <= F.when(F.col("block") == F.col("to_b"), F.col("to_c")).otherwise(far))
    lo = F.when(first, F.col("from_o")).otherwise(0)
    hi = F.when(last, F.col("to_o")).otherwise(F.length("text"))
    piece = F.substr("text", lo + 1, F.greatest(hi - lo, F.lit(0)))
    return j.filter(inside).withColumn("_p", piece).groupBy(*PS, "id").agg(F.array_join(F.array_sort(F.collect_list(
        F.struct("block", "c", F.col("_p").alias("t")))).getField("t"), "\n").alias("quote"))


# ---- lists --------------------------------------------------------------------------------------------

def is_live() -> Column:
    return (F.col("owner") == "ours") | ~F.col("resolved")


def group_of() -> Column:
    return (F.when((F.col("side") == "a") & (F.col("owner") == "ours") & F.col("changed_by_them"), "changed")
            .when((F.col("owner") == "theirs") & F.col("resolved"), "resolved").when(F.col("plain"), "plain")
            .otherwise(F.col("owner")))


def group_counts(threads: DataFrame, by: list[str]) -> DataFrame:
    g = threads.withColumn("grp", group_of())
    n = lambda k: F.count_if(F.col("grp") == k).alias(f"n_{k}")
    open_ = (F.col("side") == "b") & (F.col("owner") == "theirs") & ~F.col("resolved") & ~F.col("replied")
    return g.groupBy(*by).agg(*[n(k) for k in ("changed", "theirs", "resolved", "ours", "plain")],
                              F.count_if(is_live()).alias("live"), F.count_if(open_).alias("unreplied"))


def best_for_change(threads: DataFrame, links: DataFrame) -> DataFrame:
    """best(pair_id, cid, side, id): the most relevant thread of every change."""
    rank = (F.when(group_of() == "changed", 0)
            .when((F.col("owner") == "theirs") & ~F.col("resolved"), F.when(F.col("replied"), 2).otherwise(1))
            .when(F.col("owner") == "theirs", 4).otherwise(3))
    t = threads.withColumn("rank", rank).select(*PS, "id", "rank", "place")
    return links.join(t, [*PS, "id"]).groupBy("pair_id", "cid").agg(
        F.min(F.struct("rank", "place", "side", "id")).alias("m")).select("pair_id", "cid", "m.side", "m.id")


def document_order(threads: DataFrame) -> DataFrame:
    """Adds ``place``: by row, side b before side a within a row, rowless threads last."""
    w = Window.partitionBy("pair_id").orderBy(F.coalesce("row", F.lit(1_000_000_000)), F.when(F.col("side") == "b", 0).otherwise(1), "id")
    return threads.withColumn("place", F.row_number().over(w))


def authors(comments: DataFrame) -> DataFrame:
    return comments.filter(~T.is_anonymous(F.col("author"))).select(T.trim_ws(F.col("author")).alias("author")).distinct()


def removed_in_final(comments: DataFrame, owners: DataFrame, ours: list[str], drafted: DataFrame) -> DataFrame:
    """Comments of side b that the clean copy loses, by owner: roots by thread owner, replies by author;
    replies drafted here (pair_id) count as ours."""
    mine = T.norm_name(F.col("author")).isin(["".join(x.split()).lower() for x in ours])
    o = owners.select(*PS, "id", "owner")
    c = comments.filter("side = 'b'").join(o, [*PS, "id"], "left").select(
        "pair_id", F.coalesce("owner", F.when(mine, "ours").otherwise("theirs")).alias("owner"))
    all_ = c.unionByName(drafted.select("pair_id", F.lit("ours").alias("owner")))
    return all_.groupBy("pair_id").agg(F.count_if(F.col("owner") == "theirs").alias("theirs"), F.count_if(F.col("owner") == "ours").alias("ours"))


def internal_comments(threads: DataFrame, comments: DataFrame, roots: DataFrame, ours: list[str], reviewer: str,
                      drops: DataFrame | None = None) -> DataFrame:
    """internal(pair_id, id, author, root): comments of ours an outgoing draft would carry; dropping a
    root drops its replies (drops: pair_id, id)."""
    norm = lambda s: "".join(s.split()).lower()
    names = [norm(x) for x in ours if norm(x) != norm(reviewer)]
    b = threads.filter("side = 'b'")
    own = b.filter("internal").select("pair_id", "id", "author", F.lit(True).alias("root"))
    rest = b.filter(~F.col("internal")).select(*PS, F.col("id").alias("root"))
    rep = roots.filter("id <> root").join(rest, [*PS, "root"]).join(comments.select(*PS, "id", "author"), [*PS, "id"]) \
        .filter(T.norm_name(F.col("author")).isin(names)).select("pair_id", "id", "author", F.lit(False).alias("root"))
    out = own.unionByName(rep)
    if drops is not None:
        gone = drops.select("pair_id", F.col("id").alias("root")).join(roots.filter("side = 'b'"), ["pair_id", "root"]) \
            .select("pair_id", "id").unionByName(drops.select("pair_id", "id")).distinct()
        out = out.join(gone, ["pair_id", "id"], "left_anti")
    return out
