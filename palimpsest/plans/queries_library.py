"""Queries: fingerprints, version matching, version chains, rounds, hints and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import fingerprint as fp, library as lib
from palimpsest.options import MATCH_MIN, TIE_GAP
from palimpsest.session import written
from palimpsest.plans import revisions
from palimpsest.plans.catalog import Tables, query
from palimpsest.plans.inputs import WS_SQL, cte, iso, iso_sql, lines, q, with_

NORM_SQL = f"lower(regexp_replace(line, {q(WS_SQL + '+')}, '', 'g'))"
cte("ph", f"SELECT DISTINCT doc_id, md5({NORM_SQL}) AS h FROM lines WHERE length({NORM_SQL}) >= 4", "lines")
cte("fps", "SELECT doc_id, string_agg(h, ',' ORDER BY h) AS cls, count(*) AS n FROM ph GROUP BY doc_id", "ph")


def _hashes(t: Tables) -> DataFrame:
    return fp.paragraph_hashes(lines(t), ["doc_id"])


def _classes(t: Tables) -> DataFrame:
    return fp.classes(fp.fingerprints(_hashes(t), ["doc_id"]))


@query("ag8_fingerprint", with_("fps", "SELECT doc_id, n, md5(cls) AS sig FROM fps"))
def _(t: Tables) -> DataFrame:
    h = fp.paragraph_hashes(lines(t), ["doc_id"], hashed=F.md5)
    return fp.fingerprints(h, ["doc_id"]).select(
        "doc_id", F.size("fp").cast("long").alias("n"), F.md5(F.array_join("fp", ",")).alias("sig"))


@query("str5_fingerprint_text", with_("lines", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {NORM_SQL} AS norm FROM lines"))
def _(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "pos", T.fp_norm(F.col("line")).alias("norm"))


# One representative per class of copies, on both sides.
cte("reps", "SELECT cls, min(doc_id) AS rep, count(*) AS copies FROM fps GROUP BY cls", "fps")
cte("rep_h", "SELECT r.rep, ph.h, f.n FROM reps r JOIN fps f ON f.doc_id = r.rep JOIN ph ON ph.doc_id = r.rep", "reps")
cte("overlap_scores", """SELECT d.rep AS doc_id, v.rep AS ver_id, count(*) * 1.0 / v.n AS score FROM rep_h d JOIN rep_h v ON d.h = v.h
    WHERE d.rep <> v.rep GROUP BY d.rep, v.rep, v.n""", "rep_h")


@query("jn12_overlap_join", with_("overlap_scores", "SELECT doc_id, ver_id, round(score, 6) AS score FROM overlap_scores WHERE score >= 0.5"))
def _(t: Tables) -> DataFrame:
    # a class is named by its smallest document, so the pairs need no further join
    one = written(_classes(t).groupBy("cls").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp"))) \
        .select(F.struct("id").alias("cls"), "fp")
    m = fp.match_classes(one, one).filter("doc_cls <> ver_cls")
    return m.select(F.col("doc_cls.id").alias("doc_id"), F.col("ver_cls.id").alias("ver_id"), F.round("score", 6).alias("score"))


@query("revision_pairs", with_("overlap_scores", """SELECT DISTINCT least(doc_id, ver_id) AS doc_a, greatest(doc_id, ver_id) AS doc_b FROM (SELECT *, row_number() OVER (
    PARTITION BY doc_id ORDER BY score DESC, ver_id) AS k FROM overlap_scores WHERE score >= 0.5) WHERE k = 1"""))
def _(t: Tables) -> DataFrame:
    return revisions.revision_pairs(t.documents).select("doc_a", "doc_b")


@query("revision_changes")
def _(t: Tables) -> DataFrame:
    return revisions.revision_changes(t.documents)


@query("set2_fingerprint_intersection", with_("ph", """SELECT a.doc_id, count(b.h) AS common FROM ph a
    LEFT JOIN (SELECT doc_id - 1 AS doc_id, h FROM ph) b ON a.doc_id = b.doc_id AND a.h = b.h GROUP BY a.doc_id"""))
def _(t: Tables) -> DataFrame:
    f = fp.fingerprints(_hashes(t), ["doc_id"])
    nxt = f.select((F.col("doc_id") - 1).alias("doc_id"), F.col("fp").alias("next"))
    return f.join(nxt, "doc_id", "left").select(
        "doc_id", F.coalesce(F.size(F.array_intersect("fp", "next")), F.lit(0)).cast("long").alias("common"))


# The library is the even documents, the arrivals are the odd ones.
cte("arr_scores", """SELECT d.doc_id, v.doc_id AS ver_id, count(*) * 1.0 / f.n AS score FROM ph d JOIN ph v ON d.h = v.h
    JOIN fps f ON f.doc_id = v.doc_id WHERE d.doc_id % 2 = 1 AND v.doc_id % 2 = 0 GROUP BY d.doc_id, v.doc_id, f.n""", "ph", "fps")
cte("arr_ranked", """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ver_id) AS rk,
    lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, ver_id) AS nx FROM arr_scores""", "arr_scores")


def _library_match(t: Tables, top: int, least: float = MATCH_MIN - TIE_GAP, key: str = "doc_id"):
    c = written(_classes(t))
    odd, even = c.filter("doc_id % 2 = 1"), c.filter("doc_id % 2 = 0")
    keys = even.select("cls", F.expr(key).alias("key"), F.col("doc_id").alias("ver_id"))
    m = fp.best_matches(fp.class_sets(odd), fp.class_sets(even), keys, top, least)
    docs = odd.select("doc_id", F.col("cls").alias("doc_cls"))
    return m, even.select("cls", F.col("doc_id").alias("ver_id")), docs


@query("tk2_ranked_versions", with_("arr_ranked", """SELECT doc_id, CAST(rk AS INTEGER) AS rank, ver_id, round(score, 6) AS score
    FROM arr_ranked WHERE rk <= 3 AND score >= 0.5"""))
def _(t: Tables) -> DataFrame:
    m, members, docs = _library_match(t, 3, MATCH_MIN)
    return docs.join(fp.rank_versions(m, members, 3), "doc_cls").select("doc_id", "rank", "ver_id", F.round("score", 6).alias("score"))


@query("jn13_best_version", with_("arr_ranked", """SELECT doc_id, ver_id, round(score, 6) AS score,
    coalesce(score - nx < 0.02, false) AS tie FROM arr_ranked WHERE rk = 1 AND score >= 0.5"""))
def _(t: Tables) -> DataFrame:
    m, members, docs = _library_match(t, 2)
    p = fp.pick_version(fp.rank_versions(m, members, 2))
    return docs.join(p, "doc_cls").select("doc_id", "ver_id", F.round("score", 6).alias("score"), "tie")


cte("thr_best", """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, thread) AS rk,
      lead(score) OVER w AS nx, lead(thread) OVER w AS nt FROM (
    SELECT doc_id, ver_id // 20 AS thread, max(score) AS score FROM arr_scores WHERE score >= 0.5 GROUP BY ALL)
    WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, thread)""", "arr_scores")


def _thread_match(t: Tables) -> DataFrame:
    m, members, docs = _library_match(t, 2, MATCH_MIN, "doc_id div 20")
    got = fp.match_threads(m, members.withColumn("thread", F.expr("ver_id div 20")))
    return docs.join(got, "doc_cls")


@query("jn14_thread_match", with_("thr_best", """SELECT doc_id, thread, round(score, 6) AS score,
    CASE WHEN score - nx < 0.02 THEN nt END AS alt_thread FROM thr_best WHERE rk = 1"""))
def _(t: Tables) -> DataFrame:
    return _thread_match(t).select("doc_id", "thread", F.round("score", 6).alias("score"), "alt_thread")


@query("jn15_thread_or_template", with_("arr_ranked thr_best", """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id,
    CASE WHEN a.score IS NOT NULL AND (b.score IS NULL OR a.score >= b.score) THEN 'thread' ELSE 'template' END AS source,
    CASE WHEN a.score IS NOT NULL AND (b.score IS NULL OR a.score >= b.score) THEN a.thread ELSE b.ver_id END AS target
    FROM (SELECT doc_id, max(score) AS score, arg_min(thread, (-score, thread)) AS thread FROM (
        SELECT doc_id, ver_id // 20 AS thread, max(score) AS score FROM arr_scores WHERE score >= 0.5 AND ver_id % 4 = 0 GROUP BY ALL) GROUP BY doc_id) a
    FULL JOIN (SELECT doc_id, max(score) AS score, arg_min(ver_id, (-score, ver_id)) AS ver_id FROM arr_scores
        WHERE score >= 0.5 AND ver_id % 4 = 2 GROUP BY doc_id) b ON a.doc_id = b.doc_id"""))
def _(t: Tables) -> DataFrame:
    """Documents 0, 4, 8, … are in threads, 2, 6, 10, … are templates."""
    c = written(_classes(t))
    odd = c.filter("doc_id % 2 = 1")
    docs = odd.select("doc_id", F.col("cls").alias("doc_cls"))
    sets = fp.class_sets(odd)

    def part(r: int, key: str):
        some = c.filter(F.col("doc_id") % 4 == r)
        keys = some.select("cls", F.expr(key).alias("key"), F.col("doc_id").alias("ver_id"))
        return fp.best_matches(sets, fp.class_sets(some), keys, 2), some.select("cls", F.col("doc_id").alias("ver_id"))

    m0, in_threads = part(0, "doc_id div 20")
    m2, in_templates = part(2, "doc_id")
    th = docs.join(fp.match_threads(m0, in_threads.withColumn("thread", F.expr("ver_id div 20"))), "doc_cls")
    tp = docs.join(fp.pick_version(fp.rank_versions(m2, in_templates, 2)), "doc_cls")
    return fp.home_match(th, tp).select("doc_id", "source", "target")


# ---- version chains -----------------------------------------------------------------------------------

def versions(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("thread"), F.col("o_orderkey").alias("id"), F.row_number().over(w).alias("n"),
        iso(F.col("o_orderdate")).alias("added"), F.md5(F.col("o_orderpriority")).alias("sha"), F.col("o_orderdate").alias("mtime"))


cte("versions", f"""SELECT o_custkey AS thread, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n,
    {iso_sql('o_orderdate')} AS added, md5(o_orderpriority) AS sha, o_orderdate AS mtime FROM orders""")


def rounds(t: Tables) -> DataFrame:
    v = lib.version_base(versions(t)).filter("base is not null")
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("b")).agg(
        F.count("*").alias("total"), F.count_if(F.col("l_returnflag") != "N").alias("decided"))
    return v.select("thread", F.col("base").alias("a"), F.col("id").alias("b"), F.col("added").alias("updated")).join(items, "b")


cte("rounds", """SELECT thread, base AS a, id AS b, added AS updated, total, decided FROM (
    SELECT *, lag(id) OVER (PARTITION BY thread ORDER BY n) AS base FROM versions) v
    JOIN (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag <> 'N') AS decided FROM lineitem GROUP BY 1) l
    ON l.l_orderkey = v.id WHERE base IS NOT NULL""", "versions")


def items(t: Tables) -> DataFrame:
    li = t.lineitem
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = li.select(
        F.col("l_orderkey").alias("b"), F.row_number().over(w).alias("ord"),
        F.concat(F.lit("Section "), F.col("l_linenumber").cast("string")).alias("clause"),
        (F.col("l_quantity").cast("int") % 5).cast("string").alias("before"), (F.col("l_partkey") % 7).cast("string").alias("after"),
        F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "R", "r").alias("v"))
    return rounds(t).select("thread", "a", "b").join(li, "b")


cte("items", """SELECT r.thread, r.a, r.b, i.ord, i.clause, i.before, i.after, i.v FROM rounds r JOIN (
    SELECT l_orderkey AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
      'Section ' || l_linenumber AS clause, CAST(CAST(floor(l_quantity) AS INTEGER) % 5 AS VARCHAR) AS before, CAST(l_partkey % 7 AS VARCHAR) AS after,
      CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'R' THEN 'r' END AS v FROM lineitem) i ON i.b = r.b""", "rounds")


@query("wn26_version_base", with_("versions", "SELECT thread, id, lag(id) OVER (PARTITION BY thread ORDER BY n) AS base FROM versions"))
def _(t: Tables) -> DataFrame:
    return lib.version_base(versions(t)).select("thread", "id", "base")


cte("last_pair", "SELECT thread, min(id) AS a, max(id) + (thread % 2) * 1000000000 AS b FROM versions GROUP BY thread", "versions")
cte("dpairs", """SELECT v.thread, CASE WHEN p.b IS NOT NULL THEN p.a ELSE v.a2 END AS a, coalesce(p.b, v.b2) AS b FROM (
    SELECT thread, max(id) FILTER (k = 2) AS a2, max(id) FILTER (k = 1) AS b2 FROM (
      SELECT *, row_number() OVER (PARTITION BY thread ORDER BY n DESC) AS k FROM versions) GROUP BY thread) v
    LEFT JOIN (SELECT p.* FROM last_pair p WHERE p.b IN (SELECT id FROM versions)) p ON p.thread = v.thread
    WHERE (CASE WHEN p.b IS NOT NULL THEN p.a ELSE v.a2 END) IS NOT NULL""", "last_pair")


def _default_pairs(t: Tables) -> DataFrame:
    v = versions(t)
    last = v.groupBy("thread").agg(F.min("id").alias("a"), (F.max("id") + F.first("thread") % 2 * 1000000000).alias("b"))
    return lib.default_pair(v, last)


@query("tk6_default_pair", with_("dpairs", "SELECT thread, a, b FROM dpairs"))
def _(t: Tables) -> DataFrame:
    return _default_pairs(t)


@query("ag28_thread_progress", with_("dpairs rounds", """SELECT d.thread, d.a, d.b, r.decided >= r.total AS finished,
    CASE WHEN r.decided < r.total THEN r.total - r.decided END AS "left" FROM dpairs d
    LEFT JOIN rounds r ON r.thread = d.thread AND r.a = d.a AND r.b = d.b"""))
def _(t: Tables) -> DataFrame:
    return lib.thread_progress(_default_pairs(t), rounds(t))


@query("wn18_drop_version", with_("versions", """SELECT thread, id, row_number() OVER (PARTITION BY thread ORDER BY n) AS n FROM (
    SELECT *, count(*) FILTER (id % 3 <> 0) OVER (PARTITION BY thread) AS keep FROM versions) WHERE id % 3 <> 0 OR keep < 2"""))
def _(t: Tables) -> DataFrame:
    v = versions(t)
    return lib.drop_versions(v, v.filter("id % 3 = 0")).select("thread", "id", F.col("n").cast("long").alias("n"))


@query("tk5_recent_pairs", with_("rounds", """SELECT thread, a, b, CAST(rk AS INTEGER) AS rank FROM (SELECT *,
    row_number() OVER (PARTITION BY thread ORDER BY updated DESC, a, b) AS rk FROM rounds) WHERE rk <= 6"""))
def _(t: Tables) -> DataFrame:
    return lib.recent_pairs(rounds(t), versions(t)).select("thread", "a", "b", "rank")


@query("jn31_pair_in_thread", with_("versions", """SELECT a.thread, a.id AS a, b.id AS b FROM versions a JOIN versions b ON a.thread = b.thread
    AND a.n < b.n AND a.sha = md5('1-URGENT') AND b.sha = md5('5-LOW')"""))
def _(t: Tables) -> DataFrame:
    asked = t.spark.sql("SELECT md5('1-URGENT') AS sha_a, md5('5-LOW') AS sha_b")
    return lib.pair_in_thread(asked, versions(t)).select("thread", "a", "b")


@query("str11_version_labels", with_("versions", """SELECT thread, id, CASE WHEN f THEN m WHEN k = 1 THEN d ELSE d || ' (' || k || ')' END AS label FROM (
    SELECT *, CAST(sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY thread, d ORDER BY n) AS INTEGER) AS k FROM (
      SELECT *, strftime(mtime, '%Y-%m') AS m, strftime(mtime, '%Y-%m-%d') AS d,
        row_number() OVER (PARTITION BY thread, strftime(mtime, '%Y-%m') ORDER BY n) = 1 AS f FROM versions))"""))
def _(t: Tables) -> DataFrame:
    return lib.version_labels(versions(t)).select("thread", "id", "label")


cte("prior", """SELECT r.*, v.n AS nb, row_number() OVER (PARTITION BY r.thread ORDER BY v.n DESC, r.a) AS age FROM rounds r
    JOIN versions v ON v.id = r.b JOIN (SELECT thread, max(n) AS lim FROM versions GROUP BY thread) x ON x.thread = r.thread WHERE v.n < x.lim""",
    "rounds")


def _target(t: Tables) -> DataFrame:
    """Every thread's last round is the one under review."""
    return versions(t).groupBy("thread").agg(F.max_by("id", "n").alias("b"))


@query("tk5_prior_rounds", with_("prior", "SELECT thread, a, b, CAST(age AS INTEGER) AS age FROM prior"))
def _(t: Tables) -> DataFrame:
    return lib.prior_rounds(rounds(t), versions(t), _target(t)).select("thread", "a", "b", "age")


def hinted(t: Tables) -> DataFrame:
    ages = lib.prior_rounds(rounds(t), versions(t), _target(t)).select("thread", "a", "b", "age")
    it = items(t)
    cur = it.join(_target(t), ["thread", "b"], "left_semi").select(
        "thread", F.col("ord").alias("cid"), F.lit("mod").alias("kind"), "clause", "before", "after", "v")
    return lib.hints(cur, it.join(ages, ["thread", "a", "b"]))


cte("hints", """SELECT c.thread, c.ord AS cid, c.v, CASE WHEN e.rej THEN 'reverted' WHEN e.thread IS NOT NULL THEN 'repeat'
      WHEN l.thread IS NOT NULL THEN 'related' END AS hint, CASE WHEN e.rej THEN 'r' ELSE e.v END AS reuse
    FROM (SELECT i.* FROM items i JOIN (SELECT thread, max(n) AS m FROM versions GROUP BY thread) x ON x.thread = i.thread
          JOIN versions v ON v.id = i.b AND v.n = x.m) c
    LEFT JOIN (SELECT i.thread, before, after, bool_or(v = 'r') AS rej, arg_min(v, (age, ord)) AS v FROM items i
      JOIN prior p ON p.b = i.b WHERE v IS NOT NULL GROUP BY 1, 2, 3) e ON e.thread = c.thread AND e.before = c.before AND e.after = c.after
    LEFT JOIN (SELECT DISTINCT i.thread, clause FROM items i JOIN prior p ON p.b = i.b WHERE v IS NOT NULL) l
      ON l.thread = c.thread AND l.clause = c.clause""", "items", "prior")


@query("jn21_prior_hints", with_("hints", "SELECT thread, CAST(cid AS INTEGER) AS cid, hint, reuse FROM hints"))
def _(t: Tables) -> DataFrame:
    return hinted(t).select("thread", "cid", "hint", "reuse")


@query("dec2_reuse_verdicts", with_("hints", """SELECT thread, CAST(cid AS INTEGER) AS cid, coalesce(v, reuse) AS v,
    v IS NULL AND reuse IS NOT NULL AS reused FROM hints"""))
def _(t: Tables) -> DataFrame:
    from palimpsest.operators.review import reuse_verdicts
    return reuse_verdicts(hinted(t)).select("thread", "cid", "v", "reused")


@query("jn22_clause_history", with_("items", """SELECT i.thread, i.clause, i.b, CAST(i.ord AS INTEGER) AS ord,
    CAST(row_number() OVER (PARTITION BY i.thread, i.clause ORDER BY v.n, i.a, i.ord) AS INTEGER) AS step FROM items i
    JOIN versions v ON v.id = i.b JOIN (SELECT thread, max(n) AS m FROM versions GROUP BY thread) x ON x.thread = i.thread
    WHERE v.n < x.m AND i.clause IS NOT NULL"""))
def _(t: Tables) -> DataFrame:
    clauses = items(t).filter("clause is not null").select("thread", "clause").distinct()
    asked = clauses.join(_target(t).select("thread", F.col("b").alias("up_to")), "thread")
    return lib.clause_history(items(t), versions(t), asked).select("thread", "clause", "b", "ord", "step")


# ---- stores -------------------------------------------------------------------------------------------

def files(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.element_at(
        F.array(F.lit("txt"), F.lit("pdf"), F.lit("docx")), (F.col("doc_id") % 3 + 1).cast("int")).alias("ext"),
        F.octet_length("text").cast("long").alias("size"))


cte("files", """SELECT doc_id, sha256(text) AS sha, ['txt','pdf','docx'][doc_id % 3 + 1] AS ext, strlen(text) AS size FROM documents""")


@query("src6_file_facts", with_("files", "SELECT doc_id, sha, size FROM files"))
def _(t: Tables) -> DataFrame:
    return files(t).select("doc_id", "sha", "size")


@query("prj10_identical_files", with_("files", """SELECT a.doc_id, a.sha = b.sha AS identical FROM files a JOIN files b ON b.doc_id = a.doc_id + 1"""))
def _(t: Tables) -> DataFrame:
    nxt = files(t).select((F.col("doc_id") - 1).alias("doc_id"), F.col("sha").alias("next"))
    return files(t).join(nxt, "doc_id").select("doc_id", (F.col("sha") == F.col("next")).alias("identical"))


@query("sto1_dedupe_files", with_("files", "SELECT sha, ext, min(doc_id) AS doc_id FROM files GROUP BY sha, ext"))
def _(t: Tables) -> DataFrame:
    return lib.dedupe_files(files(t), F.col("doc_id")).select("sha", "ext", "doc_id")


@query("sto2_purge_unreferenced", with_("files", """SELECT doc_id FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""))
def _(t: Tables) -> DataFrame:
    return lib.unreferenced(files(t), t.labels, ["doc_id"]).select("doc_id")


@query("set4_except", "SELECT doc_id FROM labels EXCEPT SELECT conv_id FROM conversations")
def _(t: Tables) -> DataFrame:
    return lib.unreferenced(t.labels.select("doc_id").distinct(), t.conversations.select(F.col("conv_id").alias("doc_id")), ["doc_id"])


@query("sto3_usage", f"SELECT count(*) AS n, CAST(sum(o_totalprice) AS BIGINT) AS bytes, min({iso_sql('o_orderdate')}) AS oldest FROM orders")
def _(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_totalprice"), iso(F.col("o_orderdate")).alias("updated"))
    return lib.usage(o, "o_totalprice", "updated").withColumn("bytes", F.round("bytes").cast("long"))


def saves(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("pk"), "event_id", iso(F.col("ts")).alias("updated"),
                           (F.col("event_id") % 50).alias("total"), (F.col("event_id") % 50 % 7).alias("decided"))


cte("saves", f"SELECT user_id AS pk, event_id, {iso_sql('ts')} AS updated, event_id % 50 AS total, event_id % 50 % 7 AS decided FROM events")


@query("sto4_review_upsert", with_("saves", """SELECT pk, arg_max(total, (updated, event_id)) AS total, arg_max(decided, (updated, event_id)) AS decided,
    max(updated) AS updated FROM saves GROUP BY pk"""))
def _(t: Tables) -> DataFrame:
    s = saves(t)
    got = lib.upsert(s.filter("event_id % 2 = 0"), s.filter("event_id % 2 = 1"), ["pk"], "updated", [F.col("event_id").desc()])
    return got.select("pk", "total", "decided", "updated")


cte("save_old", "SELECT pk, max(updated) AS updated, 'old' AS src FROM saves WHERE event_id % 2 = 0 AND pk % 5 <> 0 GROUP BY pk", "saves")
cte("save_new", "SELECT pk, max(updated) AS updated, 'new' AS src FROM saves WHERE event_id % 2 = 1 GROUP BY pk", "saves")


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = saves(t)
    last = lambda df, src: df.groupBy("pk").agg(F.max("updated").alias("updated")).withColumn("src", F.lit(src))
    return last(s.filter("event_id % 2 = 0 and pk % 5 <> 0"), "old"), last(s.filter("event_id % 2 = 1"), "new")


@query("sto5_import_newer", with_("save_old save_new", """SELECT pk, arg_max(updated, (updated, src = 'old')) AS updated,
    arg_max(src, (updated, src = 'old')) AS src FROM (FROM save_old UNION ALL FROM save_new) GROUP BY pk"""))
def _(t: Tables) -> DataFrame:
    return lib.import_newer(*_old_new(t), ["pk"])


@query("sto6_retention", with_("saves", "SELECT pk, event_id FROM saves WHERE updated >= '2024-01-10'"))
def _(t: Tables) -> DataFrame:
    return lib.retain(saves(t), "2024-01-10").select("pk", "event_id")


@query("sto7_recent_pairs", with_("saves", """SELECT pk, path_a, path_b, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
    PARTITION BY pk ORDER BY updated DESC, path_a, path_b) AS rk FROM (SELECT pk, event_id % 9 AS path_a, event_id % 11 AS path_b,
      max(updated) AS updated FROM saves GROUP BY ALL)) WHERE rk <= 12"""))
def _(t: Tables) -> DataFrame:
    s = saves(t).withColumn("path_a", F.col("event_id") % 9).withColumn("path_b", F.col("event_id") % 11)
    return lib.recent_list(s, "pk", "updated").select("pk", "path_a", "path_b", "rank")


@query("sto8_keep_old_items", with_("save_old save_new", """SELECT n.pk, CASE WHEN n.pk % 3 = 0 THEN n.updated ELSE o.updated END AS items
    FROM save_new n LEFT JOIN save_old o ON o.pk = n.pk"""))
def _(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    new = new.select("pk", F.when(F.col("pk") % 3 == 0, F.col("updated")).alias("items"))
    return lib.keep_old_items(new, old.select("pk", F.col("updated").alias("items")), ["pk"])


@query("sto9_write_check", """SELECT coalesce(a.path, e.path) AS path, CASE WHEN a.size IS NOT NULL AND e.size IS NULL THEN 'exists'
      WHEN a.size IS NOT NULL AND (abs(a.mtime - e.mtime) > 1 OR a.size <> e.size) THEN 'modified' WHEN a.size IS NULL THEN 'gone'
      WHEN a.path % 5 = 0 THEN 'locked' END AS code
    FROM (SELECT s_suppkey AS path, 1000 + s_suppkey % 4 AS mtime, s_nationkey AS size FROM supplier WHERE s_suppkey % 7 <> 0) a
    FULL JOIN (SELECT s_suppkey AS path, 1000 AS mtime, CASE WHEN s_suppkey % 6 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS size FROM supplier
      WHERE s_suppkey % 11 <> 0) e ON a.path = e.path""")
def _(t: Tables) -> DataFrame:
    s = t.supplier.select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("size"))
    actual = s.filter("path % 7 <> 0").withColumn("mtime", F.col("path") % 4 + 1000).withColumn("locked", F.col("path") % 5 == 0)
    expected = s.filter("path % 11 <> 0").withColumn("mtime", F.lit(1000)).withColumn(
        "size", F.when(F.col("path") % 6 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return lib.write_check(actual, expected)


@query("prj7_live_items", "SELECT p_partkey AS id FROM part WHERE p_size % 3 <> 0 AND p_size % 5 <> 0")
def _(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, 1).alias("deleted"),
                      F.when(F.col("p_size") % 5 == 0, 1).alias("archived"))
    return lib.live(p).select("id")
