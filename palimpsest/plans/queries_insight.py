"""Queries: clauses, context, risks, overviews, decisions and review progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import numbers as N, text as T
from palimpsest.operators import changes as ch, insight as ins, report as rep, review as rv
from palimpsest.operators.tokens import kind_id
from palimpsest.options import CompareOptions, RiskOptions
from palimpsest.plans import compare as cp
from palimpsest.plans.catalog import Tables, query
from palimpsest.plans.inputs import WS_SQL, blocks, cte, iso, iso_sql, lines, q, script, with_

O = CompareOptions(formatting=False)

# ---- clauses ------------------------------------------------------------------------------------------


def clause_lines(t: Tables) -> DataFrame:
    line = F.when(F.col("pos") % 5 == 0, F.concat(
        F.lit("Section "), F.expr("pos div 5 + 1").cast("string"), F.lit(" "), F.substring("line", 1, 28))).otherwise(F.col("line"))
    return lines(t).select("doc_id", "pos", line.alias("line"), F.when(F.col("pos") % 7 == 0, "h").otherwise("p").alias("kind"))


cte("clause_lines", """SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN 'Section ' || (pos // 5 + 1) || ' ' || left(line, 28) ELSE line END AS line,
    CASE WHEN pos % 7 = 0 THEN 'h' ELSE 'p' END AS kind FROM lines""", "lines")
SQ = f"trim(regexp_replace(line, {q(WS_SQL + '+')}, ' ', 'g'))"
# Only the Latin clause words occur in the tables.
CLAUSE_SQL = q(rf"(?i)^[{T.WS}]*(Article[{T.WS}]+[\dIVXLC]+|Section[{T.WS}]+\d+(\.\d+)*|Clause[{T.WS}]+\d+|\d{{1,2}}(\.\d{{1,2}}){{0,2}}[、.．][{T.WS}]*[^{T.WS}])")
CLIP28 = f"CASE WHEN length({SQ}) > 28 THEN left({SQ}, 28) || '…' ELSE {SQ} END"
TITLE_SQL = f"CASE WHEN {SQ} = '' THEN NULL WHEN kind = 'h' THEN {CLIP28} WHEN length({SQ}) <= 40 AND regexp_matches({SQ}, {CLAUSE_SQL}) THEN {CLIP28} END"


@query("prj5_clause_titles", with_("clause_lines", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {TITLE_SQL} AS title FROM clause_lines"))
def _(t: Tables) -> DataFrame:
    return clause_lines(t).select("doc_id", "pos", T.clause_title(F.col("line"), F.col("kind")).alias("title"))


cte("clauses", f"""SELECT doc_id, pos, last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clause
    FROM (SELECT doc_id, pos, CASE WHEN f AND kind = 'h' AND NOT regexp_matches(line, {CLAUSE_SQL}) THEN NULL ELSE {TITLE_SQL} END AS t
      FROM (SELECT *, full_ AND sum(CASE WHEN full_ THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) = 1 AS f
        FROM (SELECT *, {SQ} <> '' AS full_ FROM clause_lines)))""", "clause_lines")


@query("wn1_clause_anchors", with_("clauses", "SELECT doc_id, CAST(pos AS INTEGER) AS pos, clause FROM clauses"))
def _(t: Tables) -> DataFrame:
    rows = clause_lines(t).select(F.col("doc_id").alias("pair_id"), F.col("pos").alias("row"), F.lit("body").alias("sec"),
                                  F.col("kind").alias("blk_kind"), F.col("line").alias("text"))
    return ins.row_clauses(rows).select(F.col("pair_id").alias("doc_id"), F.col("row").alias("pos"), "clause")


@query("prj4_page_number_lines", """SELECT o_orderkey, regexp_matches(s, '(?i)^[-–—]?\\s*(第\\s*)?\\d*\\s*页?\\s*([/／]|共|of)?\\s*\\d*\\s*页?\\s*[-–—]?$')
      OR regexp_matches(s, '(?i)^page\\s*\\d*\\s*(of\\s*\\d*)?$') AS page_number FROM (
    SELECT o_orderkey, ['- ' || o_custkey || ' -', o_orderkey || ' / 9', 'Page ' || o_custkey || ' of 12', '第 ' || o_custkey || ' 页', o_orderpriority, '12 a'][o_orderkey % 6 + 1] AS s FROM orders)""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_custkey").cast("string")
    s = F.element_at(F.array(F.concat(F.lit("- "), k, F.lit(" -")), F.concat(F.col("o_orderkey").cast("string"), F.lit(" / 9")),
                             F.concat(F.lit("Page "), k, F.lit(" of 12")), F.concat(F.lit("第 "), k, F.lit(" 页")),
                             F.col("o_orderpriority"), F.lit("12 a")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return t.orders.select("o_orderkey", T.is_page_number(s).alias("page_number"))


# ---- context and risks --------------------------------------------------------------------------------

FEE_A = " fee USD 1,200 within 30 days from 2026-03-01"
FEE_B = " fee USD 1,500 within 45 days from 2026-04-01"


def _risky(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each risky line is a pair of its own, so that its partner is known."""
    ln = lines(t).select((F.col("doc_id") * 100000 + F.col("pos")).alias("doc_id"), F.lit(0).alias("pos"),
                                             F.regexp_replace("line", r" \| ", " / ").alias("line"))
    add = lambda tail: blocks(ln.withColumn("line", F.concat("line", F.lit(tail))))
    return add(FEE_A), add(FEE_B)


RISKY = "SELECT doc_id * 100000 + pos AS pair_id, replace(line, ' | ', ' / ') AS line FROM lines"


@query("wn9_change_context", with_("lines", f"""SELECT pair_id, kind, before, after, CAST(length(line) + at_ AS INTEGER) AS a_start,
    CAST(length(line) + at_ + length(before) AS INTEGER) AS a_end, CAST(length(line) + {len(FEE_A)} AS INTEGER) AS a_len FROM ({RISKY}),
    (VALUES ('mod', '200', '500', 11), ('mod', '30', '45', 22), ('mod', '03', '04', 40)) v(kind, before, after, at_)"""))
def _(t: Tables) -> DataFrame:
    c = cp.compare_in_context(*_risky(t), O)
    return c.select("pair_id", "kind", "before", "after", F.col("a_start").cast("int").alias("a_start"),
                    F.col("a_end").cast("int").alias("a_end"), F.length("a").alias("a_len"))


RISKS_SQL = with_("lines", f"""SELECT pair_id, cat, k, a, b, unit, pct, days, months FROM ({RISKY}), (VALUES
    ('money', 'money', 1200.0, 1500.0, 'USD', 0.25, NULL, NULL), ('term', 'term', 30.0, 45.0, 'days', NULL, NULL, NULL),
    ('date', 'date', NULL, NULL, NULL, NULL, 31, 1)) v(cat, k, a, b, unit, pct, days, months)""")


@query("rsk1_modified_risks", RISKS_SQL)
def _(t: Tables) -> DataFrame:
    r = cp.compare_risks(*_risky(t), O)
    return r.select("pair_id", "risk.cat", "risk.k", "risk.a", "risk.b", "risk.unit", "risk.pct", "risk.days", "risk.months")


@query("rsk2_new_amounts", """SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 2 = 0 THEN 'ins' ELSE 'del' END AS kind,
    CAST(o_totalprice AS DECIMAL(18, 2))::DOUBLE AS v, ['USD', 'EUR', 'RMB'][o_custkey % 3 + 1] AS unit FROM orders""")
def _(t: Tables) -> DataFrame:
    """Every order's total, written into a new or a dropped sentence."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("USD", "EUR", "RMB")]), (F.col("o_custkey") % 3 + 1).cast("int"))
    txt = F.concat(F.lit("The buyer owes "), unit, F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" to "), "o_orderstatus", F.lit(" ("), "o_orderpriority", F.lit(")"))
    even = F.col("o_orderkey") % 2 == 0
    c = t.orders.select(F.col("o_orderkey").alias("pair_id"), F.when(even, "ins").otherwise("del").alias("kind"),
                        F.when(even, "").otherwise(txt).alias("before"), F.when(even, txt).otherwise("").alias("after"))
    return c.select("pair_id", "kind", N.first_amount(F.concat("before", "after")).alias("h")).select(
        "pair_id", "kind", "h.value", N.unit_of(F.col("h")).alias("unit")).withColumnRenamed("value", "v")


# ---- a table of changes with decisions ----------------------------------------------------------------

def chg(t: Tables) -> DataFrame:
    """changes of one pair per supplier, with decisions from the line items."""
    # named before the window: rows hashed on a column are not known to be hashed on its copy
    w = Window.partitionBy("pair_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    pk = F.col("l_partkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("del", "ins", "mod", "fmt", "move")]), (pk % 5 + 1).cast("int"))
    before = F.concat(F.lit("fee "), (F.col("l_quantity").cast("int") % 4).cast("string"))
    after = F.concat(F.lit("liability "), (pk % 3).cast("string"))
    return t.lineitem.withColumnRenamed("l_suppkey", "pair_id").select(
        "pair_id", F.row_number().over(w).alias("cid"),
        F.when(F.col("l_linenumber") == 7, "footnote").otherwise("body").alias("sec"), kind.alias("kind"),
        F.when(kind == "ins", "").otherwise(before).alias("before"), F.when(kind.isin("ins", "mod"), after).otherwise("").alias("after"),
        F.when(F.col("l_linenumber") % 4 > 0, F.concat(F.lit("Section "), (F.col("l_orderkey") % 4).cast("string"))).alias("clause"),
        F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "R", "r").when(pk % 2 == 0, "h").alias("v"),
        F.concat(F.lit("u"), (pk % 3).cast("string")).alias("by"), iso(F.col("l_shipdate")).alias("at"),
        F.when(F.col("l_tax") > 0.06, "check").alias("note"), (pk % 11).alias("m")).withColumn("row", F.col("cid") * 2)


cte("chg", f"""SELECT *, cid * 2 AS "row", CASE WHEN kind = 'ins' THEN '' ELSE b0 END AS before, CASE WHEN kind IN ('ins', 'mod') THEN a0 ELSE '' END AS after FROM (
    SELECT l_suppkey AS pair_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS cid,
      CASE WHEN l_linenumber = 7 THEN 'footnote' ELSE 'body' END AS sec, ['del','ins','mod','fmt','move'][l_partkey % 5 + 1] AS kind,
      'fee ' || (CAST(floor(l_quantity) AS INTEGER) % 4) AS b0, 'liability ' || (l_partkey % 3) AS a0,
      CASE WHEN l_linenumber % 4 > 0 THEN 'Section ' || (l_orderkey % 4) END AS clause,
      CASE WHEN l_returnflag = 'A' THEN 'a' WHEN l_returnflag = 'R' THEN 'r' WHEN l_partkey % 2 = 0 THEN 'h' END AS v,
      'u' || (l_partkey % 3) AS "by", {iso_sql('l_shipdate')} AS "at", CASE WHEN l_tax > 0.06 THEN 'check' END AS note, l_partkey % 11 AS m FROM lineitem)""")


@query("prj3_changes_of_kind", with_("chg", "SELECT pair_id, cid FROM chg WHERE kind = 'mod'"))
def _(t: Tables) -> DataFrame:
    return ins.shown_changes(chg(t), "mod").select("pair_id", "cid")


@query("prj6_risk_candidates", with_("chg", "SELECT pair_id, count(*) AS n FROM chg WHERE kind NOT IN ('fmt', 'move') GROUP BY pair_id"))
def _(t: Tables) -> DataFrame:
    return ins.risk_candidates(chg(t)).groupBy("pair_id").agg(F.count("*").alias("n"))


@query("prj11_change_bodies", with_("chg", """SELECT pair_id, cid, CASE kind WHEN 'mod' THEN '“' || before || '” → “' || after || '”' WHEN 'del' THEN '“' || before || '”'
      WHEN 'ins' THEN '“' || after || '”' WHEN 'fmt' THEN '“' || before || '” (bold)' ELSE '“' || before || '” (block moved)' END AS body,
    CASE WHEN v IS NULL THEN CASE WHEN note IS NULL THEN '' ELSE 'Note: ' || note END ELSE "by" || ' · ' ||
      CASE v WHEN 'a' THEN 'Accepted' WHEN 'r' THEN 'Rejected' ELSE 'On hold' END || coalesce(': ' || note, '') END AS verdict FROM chg"""))
def _(t: Tables) -> DataFrame:
    return chg(t).select("pair_id", "cid", rep.change_body(F.col("kind"), F.col("before"), F.col("after"), F.lit("bold")).alias("body"),
                         rep.verdict_text(F.col("v"), F.col("by"), F.col("note")).alias("verdict"))


cte("kwhits", """SELECT pair_id, cid, CASE WHEN contains(lower(before || '~' || after || '~' || coalesce(clause, '')), 'liability') THEN 'liability' ELSE '' END AS kw
    FROM chg WHERE kind NOT IN ('fmt', 'move')""", "chg")


@query("ag25_keyword_hits", with_("kwhits", "SELECT * FROM kwhits"))
def _(t: Tables) -> DataFrame:
    kw = N.keyword_hits(["damages", "Liability"], F.col("before"), F.col("after"), F.col("clause"))
    return ins.risk_candidates(chg(t)).select("pair_id", "cid", F.lower(F.array_join(kw, ",")).alias("kw"))


def _chg_risks(t: Tables) -> DataFrame:
    c = chg(t).select("pair_id", "cid", "kind", "before", "after", "clause", F.col("before").alias("a"), F.lit(0).alias("a_start"),
                      F.length("before").alias("a_end"), F.col("after").alias("b"), F.lit(0).alias("b_start"), F.length("after").alias("b_end"))
    return ins.detect_risks(c, RiskOptions(money=False, date=False, keywords=("liability",)))


@query("rsk3_keyword_risks", with_("kwhits", "SELECT pair_id, cid, 'kw' AS cat FROM kwhits WHERE kw <> ''"))
def _(t: Tables) -> DataFrame:
    return _chg_risks(t).select("pair_id", "cid", "risk.cat")


@query("tk1_risk_order", with_("chg", """SELECT pair_id, cid, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY CASE WHEN m < 6 THEN m % 3 ELSE 3 END, cid) AS INTEGER) AS place FROM chg"""))
def _(t: Tables) -> DataFrame:
    r = chg(t).select("pair_id", "cid", F.when(F.col("m") < 6, F.col("m") % 3).otherwise(3).alias("rank"))
    return ins.risk_order(r).select("pair_id", "cid", "place")


@query("ag5_patterns", with_("chg", """SELECT pair_id, kind, before, after, n, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, f) AS rk
    FROM (SELECT *, sum(n) OVER (PARTITION BY pair_id) AS total FROM (SELECT pair_id, kind, before, after, count(*) AS n, min(cid) AS f FROM chg GROUP BY ALL))
    WHERE total >= 300 AND n >= 10) WHERE rk <= 6"""))
def _(t: Tables) -> DataFrame:
    return ins.patterns(chg(t), ["pair_id"], top=6, least=10, least_all=300).select("pair_id", "kind", "before", "after", "n", "rank")


@query("ag6_change_density", with_("chg", """, b AS (SELECT pair_id, least(119, CAST(floor("row" * 1.0 / (c.n * 2 + 1) * 120) AS BIGINT)) AS bucket, kind FROM chg JOIN (
      SELECT pair_id, count(*) AS n FROM chg GROUP BY pair_id) c USING (pair_id)),
    k AS (SELECT pair_id, bucket, sum(k) AS n, arg_max(kind, (k, CASE kind WHEN 'del' THEN 5 WHEN 'mod' THEN 4 WHEN 'ins' THEN 3 WHEN 'move' THEN 2 ELSE 1 END)) AS kind
      FROM (SELECT pair_id, bucket, kind, count(*) AS k FROM b GROUP BY ALL) GROUP BY ALL)
    SELECT pair_id, bucket, CAST(n AS BIGINT) AS n, kind, CASE WHEN n / m > 0.66 THEN 3 WHEN n / m > 0.33 THEN 2 ELSE 1 END AS level FROM (
      SELECT *, max(n) OVER (PARTITION BY pair_id) AS m, sum(n) OVER (PARTITION BY pair_id) AS total FROM k) WHERE total > 200""").replace("\n, b AS", ",\nb AS"))
def _(t: Tables) -> DataFrame:
    c = chg(t).withColumn("n_rows", F.count("*").over(Window.partitionBy("pair_id")) * 2 + 1)
    return ins.density(c, ["pair_id"], dense=200).select("pair_id", "bucket", "n", "kind", "level")


@query("ag11_format_noise", with_("chg", """SELECT pair_id, n, CASE WHEN f >= n * 0.6 AND s >= n * 0.6 THEN 'both' WHEN f >= n * 0.6 THEN 'font' WHEN s >= n * 0.6 THEN 'size' ELSE 'any' END AS kind
    FROM (SELECT pair_id, count(*) AS total, count(*) FILTER (kind = 'fmt') AS n, count(*) FILTER (kind = 'fmt' AND m < 8) AS f,
      count(*) FILTER (kind = 'fmt' AND m < pair_id % 11) AS s FROM (SELECT * REPLACE (CASE WHEN pair_id % 2 = 0 AND cid % 5 > 0 THEN 'fmt' ELSE kind END AS kind) FROM chg) GROUP BY pair_id) WHERE n >= 10 AND n * 2 >= total"""))
def _(t: Tables) -> DataFrame:
    """Every pair's changes; in even pairs all but one in five are changes of format."""
    c = chg(t).withColumn("kind", F.when((F.col("pair_id") % 2 == 0) & (F.col("cid") % 5 > 0), "fmt").otherwise(F.col("kind")))
    sig = F.concat_ws(";", F.when(F.col("m") < 8, "font:A>B"), F.when(F.col("m") < F.col("pair_id") % 11, "sz:10>12"))
    return ins.format_noise(c.withColumn("sig", sig).withColumn("whole", F.lit(True)), ["pair_id"], least=10)


TITLE = "CASE WHEN sec <> 'body' THEN 'Footnotes' ELSE coalesce(clause, 'Opening') END"
cte("grp", f"""SELECT *, sum(nw) OVER (PARTITION BY pair_id ORDER BY cid) AS grp FROM (SELECT *, CASE WHEN title = lag(title) OVER (PARTITION BY pair_id ORDER BY cid)
    THEN 0 ELSE 1 END AS nw FROM (SELECT *, {TITLE} AS title FROM chg))""", "chg")


@query("ag24_clause_groups", with_("grp", "SELECT pair_id, CAST(grp AS BIGINT) AS grp, title, count(*) AS n FROM grp GROUP BY ALL"))
def _(t: Tables) -> DataFrame:
    g = ins.group_changes(chg(t), ["pair_id"], ins.group_title(F.col("sec"), F.col("clause")))
    return g.groupBy("pair_id", "grp", "title").agg(F.count("*").alias("n"))


@query("ag26_section_heads", with_("chg", """SELECT p.pair_id, p.sec, p.first_row, coalesce(c.n, 0) AS n, p.sec <> 'body' AND c.n IS NULL AS closed FROM (
      SELECT pair_id, sec, min("row") AS first_row FROM chg GROUP BY ALL) p LEFT JOIN (SELECT pair_id, sec, count(*) AS n FROM chg WHERE kind = 'mod' AND m > 5 GROUP BY ALL) c
      ON c.pair_id = p.pair_id AND c.sec = p.sec"""))
def _(t: Tables) -> DataFrame:
    c = chg(t)
    return ins.section_heads(c.select("pair_id", "sec", "row"), c.filter("kind = 'mod' and m > 5"))


@query("wn8_folded_rows", with_("chg", """SELECT pair_id, cid, keep, CAST(CASE WHEN NOT keep THEN sum(s) OVER (PARTITION BY pair_id ORDER BY cid) END AS BIGINT) AS fold FROM (
    SELECT *, CASE WHEN NOT keep AND coalesce(lag(keep) OVER (PARTITION BY pair_id ORDER BY cid), true) THEN 1 ELSE 0 END AS s FROM (
      SELECT pair_id, cid, max(m = 0) OVER (PARTITION BY pair_id ORDER BY cid ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS keep FROM chg))"""))
def _(t: Tables) -> DataFrame:
    r = chg(t).select("pair_id", "cid", F.col("cid").alias("row"), (F.col("m") == 0).alias("changed"))
    return ins.fold_rows(r, 3, ["pair_id"]).select("pair_id", "cid", "keep", "fold")


@query("ag7_document_stats", with_("lines", f"""SELECT doc_id AS pair_id, count(*) FILTER (regexp_matches(line, {q('[^' + T.WS + ']')})) AS paragraphs, 0 AS headings,
    count(*) FILTER (contains(line, ' | ')) AS table_rows, 0 AS list_items,
    CAST(sum(len(regexp_extract_all(line, {q('[' + T.CJK_WORD + ']')})) + len(regexp_extract_all(regexp_replace(line, {q('[' + T.CJK_WORD + ']')}, ' ', 'g'),
      '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''’_-]*'))) AS BIGINT) AS words,
    CAST(sum(length(replace(line, ' | ', '.'))) + count(*) - 1 AS BIGINT) AS chars,
    CAST(sum(length(regexp_replace(replace(line, ' | ', ' '), {q(WS_SQL + '+')}, '', 'g'))) AS BIGINT) AS chars_no_space FROM lines GROUP BY doc_id"""))
def _(t: Tables) -> DataFrame:
    return ins.document_stats(blocks(lines(t)), ["pair_id"])


# ---- decisions ----------------------------------------------------------------------------------------

cte("fpr", """SELECT *, base || '#' || row_number() OVER (PARTITION BY pair_id, base ORDER BY cid) AS fp FROM (
    SELECT *, sec || '|' || kind || '|' || before || '|' || after AS base FROM chg)""", "chg")


def fpr(t: Tables) -> DataFrame:
    return rv.fingerprint_changes(chg(t))


@query("wn6_change_fingerprints", with_("fpr", "SELECT pair_id, cid, fp FROM fpr"))
def _(t: Tables) -> DataFrame:
    return fpr(t).select("pair_id", "cid", "fp")


def saved(t: Tables) -> DataFrame:
    f = fpr(t).filter("cid % 3 = 0")
    return f.select(
        "pair_id", F.concat("fp", F.when(F.col("cid") % 11 == 0, "9999").otherwise("")).alias("fp"), "v", "by", "at", "note",
        (F.col("cid") % 2 == 0).alias("has_clause"), F.when(F.col("cid") % 2 == 0, F.when(F.col("cid") % 5 == 0, "other").otherwise(F.col("clause"))).alias("clause"),
        F.when(F.col("cid") % 7 == 0, 2).alias("stale"))


cte("saved", """SELECT pair_id, fp || CASE WHEN cid % 11 = 0 THEN '9999' ELSE '' END AS fp, v, "by", "at", note, cid % 2 = 0 AS has_clause,
    CASE WHEN cid % 2 = 0 THEN CASE WHEN cid % 5 = 0 THEN 'other' ELSE clause END END AS clause, CASE WHEN cid % 7 = 0 THEN 2 END AS stale FROM fpr WHERE cid % 3 = 0""", "fpr")
cte("attached", """SELECT c.pair_id, c.cid, c.fp, s.v, s.note FROM fpr c JOIN saved s ON s.pair_id = c.pair_id AND s.fp = c.fp AND s.stale IS NULL
    AND (NOT s.has_clause OR s.clause IS NOT DISTINCT FROM c.clause)""", "saved")


def _attached(t: Tables) -> DataFrame:
    return rv.attach_decisions(fpr(t).drop("v", "by", "at", "note"), saved(t))


@query("jn16_attached_decisions", with_("attached", "SELECT pair_id, cid, v, note FROM attached"))
def _(t: Tables) -> DataFrame:
    return _attached(t).filter("attached").select("pair_id", "cid", "v", "note")


@query("jn17_lost_decisions", with_("attached", """SELECT s.pair_id, count(*) AS lost FROM saved s WHERE s.v IS NOT NULL AND s.stale IS NULL
    AND NOT EXISTS (SELECT 1 FROM attached a WHERE a.pair_id = s.pair_id AND a.fp = s.fp) GROUP BY s.pair_id"""))
def _(t: Tables) -> DataFrame:
    return rv.lost_decisions(saved(t), _attached(t)).groupBy("pair_id").agg(F.count("*").alias("lost"))


@query("jn18_upgraded_decisions", with_("saved", """SELECT s.pair_id, s.fp, coalesce(CASE WHEN s.has_clause THEN s.clause IS NOT DISTINCT FROM c.clause ELSE rn = 1 AND cn = 1 END AND c.fp IS NOT NULL, false) AS kept
    FROM (SELECT *, count(*) OVER (PARTITION BY pair_id, regexp_replace(fp, '#\\d+$', '')) AS rn FROM saved WHERE stale IS NULL) s
    LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY pair_id, base) AS cn FROM fpr) c ON c.pair_id = s.pair_id AND c.fp = s.fp"""))
def _(t: Tables) -> DataFrame:
    return rv.upgrade_decisions(fpr(t), saved(t), 2).select("pair_id", "fp", "kept")


@query("jn19_saved_decisions", with_("saved", """SELECT coalesce(c.pair_id, s.pair_id) AS pair_id, coalesce(c.fp, s.fp) AS fp, CASE WHEN c.put THEN c.nv ELSE s.v END AS v,
    CASE WHEN c.put THEN c.nn ELSE s.note END AS note FROM (SELECT pair_id, fp, clause, CASE WHEN cid % 4 = 0 THEN v END AS nv, CASE WHEN cid % 4 = 0 THEN note END AS nn,
      cid % 4 = 0 AND (v IS NOT NULL OR note IS NOT NULL) AS put FROM fpr) c FULL JOIN saved s ON s.pair_id = c.pair_id AND s.fp = c.fp
    WHERE c.put OR (s.fp IS NOT NULL AND NOT (c.fp IS NOT NULL AND s.stale IS NULL AND (NOT s.has_clause OR s.clause IS NOT DISTINCT FROM c.clause)))"""))
def _(t: Tables) -> DataFrame:
    f = fpr(t)
    cur = f.filter("cid % 4 = 0").select("pair_id", "cid", "v", "by", "at", "note")
    return rv.save_decisions(f.drop("v", "by", "at", "note"), cur, saved(t)).select("pair_id", "fp", "v", "note")


@query("jn20_carried_decisions", with_("saved", """SELECT pair_id, count(*) AS n FROM (SELECT pair_id FROM saved UNION ALL SELECT -pair_id - 1 FROM saved) GROUP BY pair_id"""))
def _(t: Tables) -> DataFrame:
    """Every pair is replaced by a new one, numbered below zero, without decisions of its own."""
    own = saved(t)
    prev = own.select("pair_id").distinct().select((-F.col("pair_id") - 1).alias("pair_id"), F.col("pair_id").alias("prev_pair"))
    return rv.carry_over(own, prev, own).groupBy("pair_id").agg(F.count("*").alias("n"))


@query("jn32_next_undecided", with_("chg", """SELECT pair_id, cid, coalesce(first_value(CASE WHEN v IS NULL THEN cid END IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY cid
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN v IS NULL THEN cid END) OVER (PARTITION BY pair_id)) AS next FROM chg"""))
def _(t: Tables) -> DataFrame:
    return rv.next_undecided(chg(t)).select("pair_id", "cid", "next")


@query("ag9_review_progress", with_("chg", """SELECT pair_id, count(*) AS total, count(v) AS decided, count(*) FILTER (v = 'a') AS accepted, count(*) FILTER (v = 'r') AS rejected,
    count(*) FILTER (v = 'h') AS on_hold, string_agg(DISTINCT "by", ',' ORDER BY "by") FILTER (v IS NOT NULL) AS reviewers FROM chg GROUP BY pair_id"""))
def _(t: Tables) -> DataFrame:
    return rv.progress(chg(t))


@query("ag10_bulk_impact", with_("chg", """SELECT pair_id, count(*) AS total, count(*) FILTER (v <> 'a') AS overwrite, 0 AS clear, count(*) FILTER (v = 'a') AS same FROM chg GROUP BY pair_id"""))
def _(t: Tables) -> DataFrame:
    return rv.bulk_impact(chg(t), "a")


@query("ag12_round_items", with_("chg", "SELECT pair_id, cid, clause, before, after, v, note FROM chg WHERE v IS NOT NULL OR note IS NOT NULL"))
def _(t: Tables) -> DataFrame:
    c = chg(t)
    return rv.round_items(c.drop("v", "note"), c.select("pair_id", "cid", "v", "note"), ["pair_id", "cid"])


@query("dec1_bulk_decisions", with_("chg", """SELECT pair_id, cid, coalesce(v, 'a') AS v, CASE WHEN v IS NULL THEN 'me' ELSE "by" END AS "by", note FROM chg"""))
def _(t: Tables) -> DataFrame:
    return rv.decide_all(chg(t), "a", "me", F.lit("2026-01-01"), only_pending=True).select("pair_id", "cid", "v", "by", "note")


@query("dec1_reset_decisions", with_("chg", "SELECT pair_id, cid, CAST(NULL AS VARCHAR) AS v, note FROM chg WHERE note IS NOT NULL"))
def _(t: Tables) -> DataFrame:
    return rv.decide_all(chg(t), None, "me", F.lit("")).filter("note is not null").select("pair_id", "cid", "v", "note")


@query("dec3_undo_decision", with_("chg", """SELECT c.pair_id, c.cid, CASE WHEN c.cid IS DISTINCT FROM u.cid THEN v END AS v, note FROM chg c JOIN (
      SELECT pair_id, CASE WHEN max(v) FILTER (cid = 5) IS NOT NULL THEN 5 ELSE arg_max(cid, ("at", cid)) FILTER (v IS NOT NULL) END AS cid FROM chg GROUP BY pair_id) u
    ON u.pair_id = c.pair_id WHERE c.cid IS DISTINCT FROM u.cid OR note IS NOT NULL"""))
def _(t: Tables) -> DataFrame:
    c = chg(t)
    return rv.undo(c, c.filter("cid = 5")).select("pair_id", "cid", "v", "note")


@query("dec4_notes", with_("chg", """SELECT pair_id, cid, v, CASE WHEN cid % 5 = 0 THEN 'new' WHEN cid % 5 = 1 THEN NULL ELSE note END AS note FROM chg
    WHERE v IS NOT NULL OR CASE WHEN cid % 5 = 0 THEN 'new' WHEN cid % 5 = 1 THEN NULL ELSE note END IS NOT NULL"""))
def _(t: Tables) -> DataFrame:
    c = chg(t).select("pair_id", "cid", "v", "by", "at", "note")
    notes = c.filter("cid % 5 < 2").select("pair_id", "cid", F.when(F.col("cid") % 5 == 0, "new").otherwise("").alias("new_note"), F.lit("2026-01-01").alias("at_new"))
    return rv.set_note(c, notes, "me", ["pair_id", "cid"]).select("pair_id", "cid", "v", "note")
