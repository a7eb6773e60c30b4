"""Queries: comment threads, anchors, highlights and comment lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import comments as cm
from palimpsest.plans.catalog import Dealt, Tables, dealt, query
from palimpsest.plans.inputs import WS_SQL, cte, lines, q, script, with_

OURS, ME = ["user"], "Reviewer"


def comments(t: Tables) -> DataFrame:
    """Every turn is a comment; a turn answers the one before it. Conversation = pair = document."""
    turn = F.col("turn").cast("int")
    null = F.lit(None).cast("string")
    return t.conversations.dropDuplicates(["conv_id", "turn"]).select(
        F.col("conv_id").alias("pair_id"), F.when(F.col("conv_id") % 2 == 0, "b").otherwise("a").alias("side"), turn.alias("id"),
        F.concat(F.col("role"), F.lit(" ")).alias("author"), F.concat(F.lit("2026-01-"), F.lpad((turn * 7 % 28 + 1).cast("string"), 2, "0")).alias("date"),
        "text", F.when(turn > 0, turn - 1).alias("parent"), (F.col("conv_id") % 5 == 0).alias("done"),
        turn.alias("from_b"), F.lit(0).alias("from_c"), (turn * 3).alias("from_o"), turn.alias("to_b"), F.lit(0).alias("to_c"),
        (turn * 3 + 12).alias("to_o"), F.lit("x").alias("quote"), null.alias("del_text"))


cte("comments", """SELECT conv_id AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'b' ELSE 'a' END AS side, turn AS id, role || ' ' AS author,
    '2026-01-' || lpad(CAST(turn * 7 % 28 + 1 AS VARCHAR), 2, '0') AS date, conv_id % 5 = 0 AS done, CASE WHEN turn > 0 THEN turn - 1 END AS parent
    FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)""")
cte("roots", """SELECT c.pair_id, c.side, c.id, (SELECT max(x.id) FROM comments x WHERE x.pair_id = c.pair_id AND x.id <= c.id
    AND NOT EXISTS (SELECT 1 FROM comments y WHERE y.pair_id = x.pair_id AND y.id = x.id - 1)) AS root FROM comments c""", "comments")


def _roots(t: Tables) -> DataFrame:
    return cm.comment_roots(comments(t))


@query("jn23_comment_roots", with_("roots", "SELECT pair_id, id, root FROM roots"))
def _(t: Tables) -> DataFrame:
    return _roots(t).select("pair_id", "id", "root")


@query("tk7_replies_by_date", with_("roots", """SELECT r.pair_id, r.root, r.id, CAST(row_number() OVER (PARTITION BY r.pair_id, r.root ORDER BY c.date, r.id) AS INTEGER) AS step
    FROM roots r JOIN comments c ON c.pair_id = r.pair_id AND c.id = r.id WHERE r.id <> r.root"""))
def _(t: Tables) -> DataFrame:
    return cm.reply_order(comments(t), _roots(t)).select("pair_id", "root", "id", "step")


cte("threads", """SELECT c.pair_id, c.side, c.id, c.author, CASE WHEN c.pair_id % 7 = 0 THEN 'theirs' WHEN trim(lower(c.author)) IN ('user', 'reviewer') THEN 'ours' ELSE 'theirs' END AS owner,
    c.done AS resolved, coalesce(x.replied, false) AS replied, coalesce(x.n, 0) AS n_replies FROM comments c JOIN roots r ON r.pair_id = c.pair_id AND r.id = c.id AND r.root = c.id
    LEFT JOIN (SELECT r.pair_id, r.root, count(*) AS n, bool_or(trim(c.author) = 'user') AS replied FROM roots r JOIN comments c ON c.pair_id = r.pair_id AND c.id = r.id
      WHERE r.id <> r.root GROUP BY ALL) x ON x.pair_id = c.pair_id AND x.root = c.id""", "roots")


def _threads(t: Tables) -> DataFrame:
    c = comments(t)
    over = c.filter("pair_id % 7 = 0 and id = 0").select("pair_id", "side", "id", F.lit("theirs").alias("owner"))
    return cm.threads(c, _roots(t), OURS, ME, overrides=over)


@query("own1_thread_owners", with_("threads", "SELECT pair_id, id, owner, side = 'b' AND owner = 'ours' AS internal, resolved, replied, n_replies FROM threads"))
def _(t: Tables) -> DataFrame:
    return _threads(t).select("pair_id", "id", "owner", "internal", "resolved", "replied", "n_replies")


# ---- anchors in the known script ----------------------------------------------------------------------

def tokens(t: Tables, of: DataFrame | None = None) -> DataFrame:
    s = script(dealt(t), of).withColumn("cid", F.when((F.col("op") != 0) | F.col("fmt").isNotNull(), F.col("ix")))
    side = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.lit(x).alias("side"), F.col(f"{x}.t").alias("t")))
    both = s.select("pair_id", "row", "ix", "op", "fmt", "cid", F.explode(F.filter(F.array(side("a"), side("b")), lambda z: z.isNotNull())).alias("z"))
    return both.select(
        "pair_id", "z.side", "row", "ix", F.col("row").alias("block"), F.lit(0).alias("blk"), F.lit(0).alias("c"), "z.t",
        F.lit(False).alias("sep"), F.lit(False).alias("psep"), "op", "fmt", "cid")


cte("offsets", """SELECT *, e - length(t) AS s FROM (SELECT *, sum(length(t)) OVER (PARTITION BY pair_id, side, "row" ORDER BY ix) AS e FROM (
    SELECT pair_id, 'a' AS side, "row", ix, at_ AS t, op, fmt, CASE WHEN op <> 0 OR fmt IS NOT NULL THEN ix END AS cid FROM script WHERE at_ IS NOT NULL
    UNION ALL SELECT pair_id, 'b', "row", ix, bt_, op, fmt, CASE WHEN op <> 0 OR fmt IS NOT NULL THEN ix END FROM script WHERE bt_ IS NOT NULL))""", "script")
cte("marks", """SELECT o.pair_id, o.side, c.id, o."row", o.ix, greatest(o.s, c.id * 3) AS s, least(o.e, c.id * 3 + 12) AS e, o.s AS tok_s, o.op, o.fmt, o.cid
    FROM comments c JOIN offsets o ON o.pair_id = c.pair_id AND o.side = c.side AND o."row" = c.id WHERE o.e > c.id * 3 AND o.s < c.id * 3 + 12 AND o.e > o.s""",
    "comments", "offsets")


def _offsets(t: Tables, of: DataFrame | None = None) -> DataFrame:
    return cm.token_offsets(tokens(t, of))


def _dealt_comments(t: Dealt) -> DataFrame:
    """Comments dealt as the documents are: however many, they come to the tokens and not the tokens to them."""
    return t.deal(comments(t), "pair_id")


def _commented(t: Dealt, by: list[str]) -> DataFrame:
    """The lines that an inner join of tokens with the blocks (or pairs) of all comments can meet."""
    c = _dealt_comments(t).select(F.col("pair_id").alias("doc_id"), F.explode(F.sequence("from_b", "to_b")).alias("pos"))
    return lines(t).join(c.select(*by), by, "left_semi")


def _marks(t: Tables) -> DataFrame:
    t = dealt(t)
    return cm.comment_marks(_dealt_comments(t), _offsets(t, _commented(t, ["doc_id", "pos"])))


@query("wn10_token_offsets", with_("offsets", """SELECT pair_id, side, "row", count(*) AS n, CAST(sum(s) AS BIGINT) AS s, CAST(sum(e) AS BIGINT) AS e, CAST(max(e) AS BIGINT) AS len FROM offsets GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    return _offsets(t).groupBy("pair_id", "side", "row").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("e").alias("e"), F.max("e").alias("len"))


@query("jn24_comment_anchors", with_("marks", """SELECT pair_id, side, id, "row", ix, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, cid FROM marks"""))
def _(t: Tables) -> DataFrame:
    return _marks(t).select("pair_id", "side", "id", "row", "ix", "s", "e", "cid")


@query("jn24_zero_width_anchors", with_("script", """SELECT DISTINCT d.pair_id, d."row" AS id, d.cid FROM (SELECT pair_id, "row", ix, op, CASE WHEN op = -1 THEN ix END AS cid,
      coalesce(sum(length(bt_)) OVER (PARTITION BY pair_id, "row" ORDER BY ix), 0) AS at_ FROM script) d WHERE d.op = -1 AND d.at_ = 9
      AND EXISTS (SELECT 1 FROM script s WHERE s.pair_id = d.pair_id AND s."row" = d."row" AND s.bt_ IS NOT NULL)"""))
def _(t: Tables) -> DataFrame:
    """A comment after the ninth character of every line."""
    z = lines(t).select(
        F.col("doc_id").alias("pair_id"), F.lit("b").alias("side"), F.col("pos").alias("id"), F.col("pos").alias("from_b"), F.lit(0).alias("from_c"),
        F.lit(9).cast("long").alias("from_o"), F.col("pos").alias("to_b"), F.lit(0).alias("to_c"), F.lit(9).cast("long").alias("to_o"))
    off = _offsets(t)
    gone = off.filter("side = 'a' and op = -1").select("pair_id", "row", "ix", "cid")
    return cm.deleted_anchors(z, off.filter("side = 'b'"), gone).select("pair_id", "id", "cid")


@query("jn25_projected_marks", with_("marks", """SELECT m.pair_id, m.id, m.ix, CAST(m.s + o.s - m.tok_s AS BIGINT) AS s, CAST(m.e + o.s - m.tok_s AS BIGINT) AS e FROM marks m
    JOIN offsets o ON o.pair_id = m.pair_id AND o.side = 'b' AND o."row" = m."row" AND o.ix = m.ix WHERE m.side = 'a' AND m.op = 0 AND m.fmt IS NULL AND m.e > m.s"""))
def _(t: Tables) -> DataFrame:
    return cm.project_marks(_marks(t), _offsets(t).filter("side = 'b'")).select("pair_id", "id", "ix", "s", "e")


@query("jn26_opposite_marks", with_("marks", """SELECT l.pair_id, l.id, o."row", o.ix FROM (SELECT DISTINCT pair_id, side, id, "row", cid // 2 AS cid FROM marks WHERE op <> 0) l
    JOIN offsets o ON o.pair_id = l.pair_id AND o.side <> l.side AND o.cid // 2 = l.cid AND o.op <> 0 AND o.e > o.s"""))
def _(t: Tables) -> DataFrame:
    t, half = dealt(t), F.expr("cid div 2")
    links = cm.thread_changes(_marks(t).filter("op <> 0").withColumn("cid", half))
    return cm.opposite_marks(links, _offsets(t, _commented(t, ["doc_id"])).withColumn("cid", half)).select("pair_id", "id", "row", "ix")


@query("jn33_highlight_slices", with_("marks", """SELECT o.pair_id, o.side, o."row", o.ix, m.id, CAST(greatest(o.s, m.s) - o.s AS BIGINT) AS s, CAST(least(o.e, m.e) - o.s AS BIGINT) AS e
    FROM (SELECT pair_id, side, id, "row", min(s) AS s, max(e) AS e FROM marks GROUP BY ALL) m JOIN offsets o ON o.pair_id = m.pair_id AND o.side = m.side AND o."row" = m."row"
    WHERE least(o.e, m.e) > greatest(o.s, m.s)"""))
def _(t: Tables) -> DataFrame:
    t = dealt(t)
    merged = cm.merge_marks(_marks(t))
    return cm.highlight_slices(merged, _offsets(t, _commented(t, ["doc_id", "pos"]))).select("pair_id", "side", "row", "ix", "id", "s", "e")


cte("state", """SELECT pair_id, side, id, min("row") AS "row", count(DISTINCT cid) AS n_cids, count(*) FILTER (op = 0 AND fmt IS NULL) AS eq,
    count(*) FILTER (NOT (op = 0 AND fmt IS NULL)) AS ch FROM marks GROUP BY ALL""", "marks")
cte("full_threads", """SELECT t.*, s."row", coalesce(s.n_cids, 0) = 0 AS plain, t.side = 'a' AND coalesce(s.ch, 0) > 0 AS changed_by_them FROM threads t
    LEFT JOIN state s ON s.pair_id = t.pair_id AND s.id = t.id""", "threads", "state")
GRP = """CASE WHEN side = 'a' AND owner = 'ours' AND changed_by_them THEN 'changed' WHEN owner = 'theirs' AND resolved THEN 'resolved' WHEN plain THEN 'plain' ELSE owner END"""


def _full(t: Tables) -> DataFrame:
    st = cm.thread_state(_marks(t)).select("pair_id", "side", "id", "row", "plain", "changed_by_them")
    return _threads(t).join(st, ["pair_id", "side", "id"], "left") \
        .withColumn("plain", F.coalesce("plain", F.lit(True))).withColumn("changed_by_them", F.coalesce("changed_by_them", F.lit(False)))


@query("ag13_comment_groups", with_("full_threads", f"""SELECT pair_id % 10 AS part, count(*) FILTER (g = 'changed') AS n_changed, count(*) FILTER (g = 'theirs') AS n_theirs,
    count(*) FILTER (g = 'resolved') AS n_resolved, count(*) FILTER (g = 'ours') AS n_ours, count(*) FILTER (g = 'plain') AS n_plain,
    count(*) FILTER (owner = 'ours' OR NOT resolved) AS live, count(*) FILTER (side = 'b' AND owner = 'theirs' AND NOT resolved AND NOT replied) AS unreplied
    FROM (SELECT *, {GRP} AS g FROM full_threads) GROUP BY 1"""))
def _(t: Tables) -> DataFrame:
    return cm.group_counts(_full(t).withColumn("part", F.col("pair_id") % 10), ["part"])


@query("tk4_comment_order", with_("full_threads", """SELECT pair_id, id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY coalesce("row", 1000000000), side DESC, id) AS INTEGER) AS place FROM full_threads"""))
def _(t: Tables) -> DataFrame:
    return cm.document_order(_full(t)).select("pair_id", "id", "place")


@query("tk3_best_comment", with_("comments marks", """SELECT pair_id, cid, arg_min(id, (rk, id)) AS id FROM (SELECT DISTINCT m.pair_id, m.cid, c.id,
      CASE WHEN trim(c.author) = 'user' THEN CASE WHEN c.side = 'a' THEN 0 ELSE 3 END WHEN c.done THEN 4 ELSE 1 END AS rk
    FROM marks m JOIN comments c ON c.pair_id = m.pair_id AND c.id = m.id WHERE m.cid IS NOT NULL) GROUP BY pair_id, cid"""))
def _(t: Tables) -> DataFrame:
    """Every turn taken as a thread of its own."""
    links = cm.thread_changes(_marks(t))
    th = comments(t).select("pair_id", "side", "id", F.when(F.trim("author") == "user", "ours").otherwise("theirs").alias("owner"), F.col("done").alias("resolved"),
                            F.lit(False).alias("replied"), F.lit(False).alias("plain"), (F.col("side") == "a").alias("changed_by_them"), F.col("id").alias("place"))
    return cm.best_for_change(th, links).select("pair_id", "cid", "id")


@query("ag15_comment_authors", "SELECT DISTINCT trim(role) AS author FROM conversations")
def _(t: Tables) -> DataFrame:
    c = comments(t)
    return cm.authors(c.unionByName(c.withColumn("author", F.lit(" Unknown "))))


@query("ag14_removed_comments", with_("threads", """SELECT c.pair_id, count(*) FILTER (coalesce(t.owner, CASE WHEN trim(c.author) = 'user' THEN 'ours' ELSE 'theirs' END) = 'theirs') AS theirs,
    count(*) FILTER (coalesce(t.owner, CASE WHEN trim(c.author) = 'user' THEN 'ours' ELSE 'theirs' END) = 'ours') + 1 AS ours
    FROM comments c LEFT JOIN threads t ON t.pair_id = c.pair_id AND t.id = c.id WHERE c.side = 'b' GROUP BY c.pair_id"""))
def _(t: Tables) -> DataFrame:
    c = comments(t)
    drafted = c.filter("side = 'b'").select("pair_id").distinct()
    return cm.removed_in_final(c, _threads(t), OURS, drafted)


@query("set5_internal_comments", with_("threads", """SELECT pair_id, id, root FROM (
      SELECT pair_id, id, true AS root, id AS r FROM threads WHERE side = 'b' AND owner = 'ours'
      UNION ALL SELECT r.pair_id, r.id, false, r.root FROM roots r JOIN threads t ON t.pair_id = r.pair_id AND t.id = r.root JOIN comments c ON c.pair_id = r.pair_id AND c.id = r.id
        WHERE r.id <> r.root AND t.side = 'b' AND t.owner = 'theirs' AND trim(c.author) = 'user') WHERE NOT (pair_id % 4 = 0 AND r = 0)"""))
def _(t: Tables) -> DataFrame:
    c, r = comments(t), _roots(t)
    drops = c.filter("pair_id % 4 = 0 and id = 0").select("pair_id", "id")
    return cm.internal_comments(_threads(t), c, r, OURS, ME, drops).select("pair_id", "id", "root")


@query("wn22_comment_quotes", with_("lines", """SELECT doc_id AS pair_id, a.pos AS id, substr(a.line, 4) || chr(10) || left(b.line, 7) AS quote FROM lines a JOIN lines b USING (doc_id)
    WHERE b.pos = a.pos + 1"""))
def _(t: Tables) -> DataFrame:
    """A quote from the fourth character of every line to the seventh of the next."""
    ln = lines(t)
    cells = ln.select(F.col("doc_id").alias("pair_id"), F.lit("b").alias("side"), F.col("pos").alias("block"), F.lit(0).alias("c"), F.col("line").alias("text"))
    nxt = ln.select("doc_id", (F.col("pos") - 1).alias("pos"))
    c = ln.join(nxt, ["doc_id", "pos"], "left_semi").select(
        F.col("doc_id").alias("pair_id"), F.lit("b").alias("side"), F.col("pos").alias("id"), F.col("pos").alias("from_b"), F.lit(0).alias("from_c"),
        F.lit(3).alias("from_o"), (F.col("pos") + 1).alias("to_b"), F.lit(0).alias("to_c"), F.lit(7).alias("to_o"))
    return cm.quotes(c, cells).select("pair_id", "id", "quote")


# ---- names --------------------------------------------------------------------------------------------

@query("str7_author_names", f"""SELECT c_custkey, lower(regexp_replace(c_name, {q(WS_SQL + '+')}, '', 'g')) AS norm, false AS anonymous FROM customer""")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.norm_name(F.col("c_name")).alias("norm"), T.is_anonymous(F.col("c_name")).alias("anonymous"))


@query("str8_initials", """SELECT p_partkey, CASE WHEN len(w) >= 2 THEN upper(w[1][1] || w[2][1]) ELSE upper(left(p_name, 2)) END AS initials FROM (
    SELECT *, list_filter(regexp_split_to_array(trim(p_name), '[\\s._-]+'), lambda x: x <> '') AS w FROM part)""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.initials_of(F.col("p_name")).alias("initials"))
