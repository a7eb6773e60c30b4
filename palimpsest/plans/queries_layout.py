"""Queries: page layout, document structure, page images and recognised text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import docstruct as ds, layout as la, pages as pg
from palimpsest.plans.catalog import Tables, dealt, query
from palimpsest.plans.inputs import WS_SQL, cte, lines, q, with_

# ---- positioned lines ---------------------------------------------------------------------------------


def text_lines(t: Tables) -> DataFrame:
    """Twenty lines to a page, larger gaps here and there, a heading size first, a page number last."""
    h, p = F.col("h"), F.col("pos")
    body = lines(t).select(
        "doc_id", F.expr("pos div 20 + 1").cast("int").alias("page"), (p % 20).alias("k"),
        (800.0 - 12.0 * (p % 20) - F.when(h % 4 == 0, 10.0).otherwise(0.0)).alias("y"),
        F.when(p == 0, 14.0).when(h % 19 == 7, 9.0).otherwise(10.5).alias("size"),
        (72.0 + F.least(F.length("line"), F.lit(90)) * 5.0).alias("end_x"), F.contains("line", F.lit(" | ")).alias("cols"), F.col("line").alias("text"))
    # The last line of a page brings the page number along; lines that were dealt by document stay where they are.
    last = F.lead("k").over(Window.partitionBy("doc_id", "page").orderBy("k")).isNull()
    foot = F.struct(F.lit(99).alias("k"), F.lit(30.0).alias("y"), F.lit(9.0).alias("size"), F.lit(320.0).alias("end_x"), F.lit(False).alias("cols"),
                    F.concat(F.lit("Page "), F.col("page").cast("string")).alias("text"))
    own = F.struct("k", "y", "size", "end_x", "cols", "text")
    both = body.withColumn("last", last).select("doc_id", "page", F.explode(F.when(F.col("last"), F.array(own, foot)).otherwise(F.array(own))).alias("z")) \
        .select("doc_id", "page", "z.*")
    w = Window.partitionBy("doc_id").orderBy("page", "k")
    return both.withColumn("line", F.row_number().over(w) - 1).withColumn("x", F.lit(72.0)) \
        .withColumn("bold", F.lit(False)).drop("k")


cte("tl", """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1 AS line FROM (
    SELECT doc_id, pos // 20 + 1 AS page, pos % 20 AS k, 800.0 - 12.0 * (pos % 20) - CASE WHEN h % 4 = 0 THEN 10.0 ELSE 0.0 END AS y,
      CASE WHEN pos = 0 THEN 14.0 WHEN h % 19 = 7 THEN 9.0 ELSE 10.5 END AS size, 72.0 + least(length(line), 90) * 5.0 AS end_x, contains(line, ' | ') AS cols, line AS text FROM lines
    UNION ALL SELECT DISTINCT doc_id, pos // 20 + 1, 99, 30.0, 9.0, 320.0, false, 'Page ' || (pos // 20 + 1) FROM lines)""", "lines")


def _body(t: Tables) -> DataFrame:
    return text_lines(t).filter("y > 40")


cte("bl", "SELECT * FROM tl WHERE y > 40", "tl")
cte("prev", """SELECT *, coalesce(pp = page AND abs(ps - size) <= 0.5 AND NOT pc AND NOT cols AND py - y > 0 AND py - y < greatest(size, ps) * 4, false) AS usable, (py - y) / greatest(size, ps) AS ratio
    FROM (SELECT *, lag(page) OVER w AS pp, lag(size) OVER w AS ps, lag(cols) OVER w AS pc, lag(y) OVER w AS py FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY line))""", "bl")
cte("spacing", """SELECT p.doc_id, p.page, CASE WHEN n >= 6 THEN v[CAST(floor(0.3 * (n - 1)) AS INTEGER) + 1] WHEN n > 0 AND v[1] >= d * 0.85 THEN d END AS typical,
    CASE WHEN n >= 6 THEN 'page' WHEN n > 0 AND v[1] >= d * 0.85 THEN 'doc' ELSE 'fixed' END AS source FROM (
      SELECT doc_id, page, list(ratio ORDER BY ratio) FILTER (usable) AS v, count(*) FILTER (usable) AS n FROM prev GROUP BY ALL) p
    JOIN (SELECT doc_id, CASE WHEN n >= 6 THEN v[CAST(floor(0.3 * (n - 1)) AS INTEGER) + 1] END AS d FROM (
      SELECT doc_id, list(ratio ORDER BY ratio) FILTER (usable) AS v, count(*) FILTER (usable) AS n FROM prev GROUP BY ALL)) x ON x.doc_id = p.doc_id""", "prev")


@query("ag16_line_spacing", with_("spacing", "SELECT doc_id, CAST(page AS INTEGER) AS page, round(typical, 6) AS typical, source FROM spacing"))
def _(t: Tables) -> DataFrame:
    return la.spacing_stats(_body(t)).select("doc_id", "page", F.round("typical", 6).alias("typical"), "source")


@query("ag17_median_size", with_("tl", "SELECT doc_id, s[len(s) // 2 + 1] AS median FROM (SELECT doc_id, list(size ORDER BY size) AS s FROM tl GROUP BY doc_id)"))
def _(t: Tables) -> DataFrame:
    return la.median_size(text_lines(t))


cte("heads", f"""SELECT t.*, CASE WHEN y > 842.0 * 0.9 THEN 'top' WHEN y < 842.0 * 0.075 THEN 'bottom' END AS band,
    regexp_replace(regexp_replace(text, '\\d+', '#', 'g'), {q(WS_SQL + '+')}, '', 'g') AS mask, max(page) OVER (PARTITION BY doc_id) AS np FROM tl t""", "tl")
cte("headed", """SELECT h.*, h.band IS NOT NULL AND CASE WHEN np >= 2 THEN n.k >= greatest(2, ceil(np * 0.5)) ELSE size < m.median * 0.95 OR regexp_matches(text, '^Page \\d+$') OR trim(text) = '' END AS hf
    FROM heads h LEFT JOIN (SELECT doc_id, band, mask, count(DISTINCT page) AS k FROM heads GROUP BY ALL) n ON n.doc_id = h.doc_id AND n.band = h.band AND n.mask = h.mask
    JOIN (SELECT doc_id, s[len(s) // 2 + 1] AS median FROM (SELECT doc_id, list(size ORDER BY size) AS s FROM tl GROUP BY doc_id)) m ON m.doc_id = h.doc_id""", "heads")


@query("ag18_running_heads", with_("headed", "SELECT doc_id, CAST(line AS INTEGER) AS line, hf FROM headed"))
def _(t: Tables) -> DataFrame:
    return la.running_heads(text_lines(t)).select("doc_id", "line", "hf")


@query("str19_masked_lines", with_("heads", "SELECT doc_id, CAST(line AS INTEGER) AS line, mask FROM heads"))
def _(t: Tables) -> DataFrame:
    return text_lines(t).select("doc_id", "line", T.mask_digits(F.col("text")).alias("mask"))


@query("ag23_section_info", with_("headed", """SELECT doc_id, CASE WHEN bool_or(hf AND band = 'top' AND NOT pn) THEN 'found' WHEN max(np) >= 2 THEN 'none' ELSE 'unknown' END AS header,
    CASE WHEN bool_or(hf AND band = 'bottom' AND NOT pn) THEN 'found' WHEN max(np) >= 2 OR bool_or(hf AND pn) THEN 'none' ELSE 'unknown' END AS footer,
    CASE WHEN doc_id IN (SELECT doc_id FROM lines WHERE pos % 10 = 9) THEN 'found' ELSE 'unknown' END AS footnote,
    bool_or(hf AND pn) AS page_numbers_dropped FROM (SELECT *, regexp_matches(text, '^Page \\d+$') OR trim(text) = '' AS pn FROM headed) GROUP BY doc_id"""))
def _(t: Tables) -> DataFrame:
    t = dealt(t)
    return la.section_info(la.running_heads(text_lines(t)), _footnotes(t))


@query("wn12_full_lines", with_("bl", """SELECT doc_id, CAST(line AS INTEGER) AS line, coalesce(NOT cols AND end_x >= max(CASE WHEN NOT cols THEN end_x END) OVER (PARTITION BY doc_id, page, size) - size * 1.5, false) AS "full" FROM bl"""))
def _(t: Tables) -> DataFrame:
    return la.full_lines(_body(t)).select("doc_id", "line", "full")


WRAPS = ", ".join(f"CASE WHEN lag(page, {d}) OVER w = pp THEN lag(wr, {d}) OVER w END AS b{d}, CASE WHEN lead(page, {d}) OVER w = pp THEN lead(wr, {d}) OVER w END AS f{d}" for d in range(1, 5))


@query("wn13_gap_breaks", with_("prev spacing", f""", fl AS (SELECT *, coalesce(NOT cols AND end_x >= max(CASE WHEN NOT cols THEN end_x END) OVER (PARTITION BY doc_id, page, size) - size * 1.5, false) AS fu FROM prev),
    wr AS (SELECT *, CASE WHEN usable AND lag(fu) OVER (PARTITION BY doc_id ORDER BY line) THEN ratio END AS wr FROM fl),
    nb AS (SELECT *, {WRAPS} FROM wr WINDOW w AS (PARTITION BY doc_id ORDER BY line))
    SELECT n.doc_id, CAST(n.line AS INTEGER) AS line, coalesce(pp = n.page AND ratio > greatest(1.2 * 1.55, coalesce(coalesce(least(b1, f1), least(b2, f2), least(b3, f3), least(b4, f4), s.typical) * 1.1, 0)), false) AS gap_break
    FROM nb n LEFT JOIN spacing s ON s.doc_id = n.doc_id AND s.page = n.page""").replace("\n, fl AS", ",\nfl AS"))
def _(t: Tables) -> DataFrame:
    b = _body(t)
    return la.gap_breaks(b, la.spacing_stats(b)).select("doc_id", "line", "gap_break")


def _paragraphs(t: Tables) -> DataFrame:
    h = la.running_heads(text_lines(t)).filter("not hf").drop("band", "mask", "hf", "n_pages")
    return la.paragraphs(la.paragraph_breaks(la.gap_breaks(h, la.spacing_stats(h))))


@query("wn14_paragraphs")
def _(t: Tables) -> DataFrame:
    return _paragraphs(t).select("doc_id", "para", "page", "n_lines", "text")


@query("wn16_block_kinds", with_("lines", f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN c AND n THEN 'tr' WHEN (s >= 11.5 AND length(x) < 160) OR (b AND length(x) < 100 AND n AND m = '') THEN 'h' WHEN m <> '' THEN 'li' ELSE 'p' END AS kind,
    CAST(CASE WHEN s >= 11.5 AND length(x) < 160 AND NOT (c AND n) THEN CASE WHEN s >= 18 THEN 1 WHEN s >= 14 THEN 2 ELSE 3 END WHEN c AND n THEN NULL WHEN b AND length(x) < 100 AND n AND m = '' THEN 4 WHEN m <> '' THEN 0 END AS INTEGER) AS level, m AS mark FROM (
    SELECT *, [10.0, 12.0, 15.0, 19.0][h % 4 + 1] AS s, h % 5 = 0 AS b, contains(line, ' | ') AS c, true AS n, line AS x, CASE h % 3 WHEN 0 THEN '' ELSE '(7)' END AS m FROM (
      SELECT doc_id, pos, h, CASE h % 3 WHEN 0 THEN 'x' || line ELSE '(7) ' || line END AS line FROM lines))"""))
def _(t: Tables) -> DataFrame:
    ln = lines(t).withColumn("line", F.when(F.col("h") % 3 == 0, F.concat(F.lit("x"), "line")).otherwise(F.concat(F.lit("(7) "), "line")))
    p = ln.select("doc_id", "pos", F.lit(1).alias("n_lines"), F.element_at(F.array(*[F.lit(x) for x in (10.0, 12.0, 15.0, 19.0)]), (F.col("h") % 4 + 1).cast("int")).alias("size"),
                  F.contains("line", F.lit(" | ")).alias("cols"), (F.col("h") % 5 == 0).alias("all_bold"), F.col("line").alias("text"), F.lit(10.0).alias("median"))
    return la.classify(p).select("doc_id", "pos", "kind", "level", F.regexp_extract("text", la.BULLET_RE, 1).alias("mark"))


@query("wn11_assembled_lines", with_("lines", """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS line,
    CAST(pos // 20 + 1 AS INTEGER) AS page, text, contains(text, chr(9)) AS cols, CAST(n AS INTEGER) AS n_runs, 10.5 AS size FROM (
      SELECT doc_id, pos, len(w) + CASE WHEN h % 5 = 1 AND len(w) > 1 THEN 1 ELSE 0 END AS n, array_to_string(list_transform(w, lambda x, i:
        CASE WHEN i = 1 THEN '' WHEN w[i - 1] = '|' AND NOT (i = 2 AND h % 5 = 1) THEN chr(9) ELSE ' ' END || x), '') AS text
      FROM (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM lines)) WHERE n > 0"""))
def _(t: Tables) -> DataFrame:
    """Words of a line as text items on one baseline, with wide gaps after bars; in every fifth line the first
    gap is an item of its own, after every sixth line stands a raised two-digit reference in two pieces."""
    words = lines(dealt(t)).select("doc_id", "pos", "h", F.posexplode(F.filter(F.split("line", " "), lambda s: s != "")).alias("i", "str"))
    w = Window.partitionBy("doc_id", "pos").orderBy("i")
    own = (F.col("h") % 5 == 1) & (F.col("i") == 0)
    gap = F.when((F.col("str") == "|") & ~own, 20.0).otherwise(3.0)
    x = F.coalesce(F.sum(F.length("str") * 5.0 + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + 72.0
    y = 800.0 - F.col("pos") % 20 * 14.0
    words = words.withColumn("x", x).withColumn("width", F.length("str") * 5.0).withColumn("last", F.lead("i").over(w).isNull())
    end = F.col("x") + F.col("width")
    item = lambda k, text, at, up, size, width: F.struct(F.lit(k).alias("k"), text.alias("str"), at.alias("x"), (y + up).alias("y"), F.lit(size).alias("size"), width.alias("width"))
    note = (F.col("h") % 6 == 0) & F.col("last")
    parts = F.array(item(0, F.col("str"), F.col("x"), 0.0, 10.5, F.col("width")),
                    F.when(own & ~F.col("last"), item(1, F.lit(" "), end, 0.0, 10.5, F.lit(3.0))),
                    F.when(note, item(2, F.lit("1"), end + 1.0, 4.0, 6.0, F.lit(3.0))),
                    F.when(note, item(3, F.lit("2"), end + 4.0, 4.0, 6.0, F.lit(3.0))))
    items = words.select("doc_id", "pos", F.expr("pos div 20 + 1").cast("int").alias("page"), "i", F.explode(F.filter(parts, lambda z: z.isNotNull())).alias("z")) \
        .select("doc_id", "page", ((F.col("pos") * 1000000 + F.col("i").cast("long")) * 4 + F.col("z.k")).alias("ix"), "z.str", "z.x", "z.y", "z.size", "z.width")
    return la.assemble_lines(items).select("doc_id", "line", "page", "text", "cols", F.size("runs").alias("n_runs"), "size")


@query("wn15_footnotes", with_("lines", """SELECT doc_id, pos // 10 + 1 AS page, count(*) AS n FROM lines WHERE pos % 10 = 9 GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    return _footnotes(t).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def _footnotes(t: Tables) -> DataFrame:
    """Ten lines to a page; the last one of a full page is a small numbered line at the foot."""
    note = F.col("pos") % 10 == 9
    ln = lines(t).select("doc_id", F.col("pos").alias("line"), F.expr("pos div 10 + 1").alias("page"), F.when(note, 200.0).otherwise(700.0 - F.col("pos") % 10 * 14).alias("y"),
                         F.when(note, 8.0).otherwise(10.5).alias("size"), F.when(note, F.concat(F.lit("[1] "), "line")).otherwise(F.col("line")).alias("text"), F.lit(10.5).alias("median"))
    return la.footnotes(la.footnote_lines(ln))


@query("ag19_read_issues", """SELECT user_id AS doc_id, string_agg(DISTINCT CAST(event_id % 7 AS VARCHAR), ',' ORDER BY CAST(event_id % 7 AS VARCHAR)) AS pages, count(*) AS runs,
    string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events WHERE event_type IN ('error', 'click') GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    e = t.events.filter(F.col("event_type").isin("error", "click"))
    return la.read_issues(e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).cast("string").alias("page"), F.lit(1).alias("runs"), F.col("event_type").alias("kind")))


# ---- structure ----------------------------------------------------------------------------------------

@query("wn17_list_numbers", """WITH p AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_linenumber % 3 AS lvl FROM lineitem),
    g AS (SELECT *, count(*) FILTER (lvl < 1) OVER w AS g1, count(*) FILTER (lvl < 2) OVER w AS g2 FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lvl, CASE lvl WHEN 0 THEN 0 WHEN 1 THEN g1 ELSE g2 END ORDER BY pos) AS k FROM g),
    s AS (SELECT *, coalesce(max(CASE WHEN lvl = 0 THEN k + 4 END) OVER (PARTITION BY doc_id ORDER BY pos), 5) AS v0,
      coalesce(last_value(CASE WHEN lvl = 1 THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id, g1 ORDER BY pos), 1) AS v1 FROM v)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE lvl WHEN 0 THEN v0 || '.' WHEN 1 THEN v0 || '.' || k WHEN 2 THEN '(' || substr('abcdefghijklmnopqrstuvwxyz', CAST((k - 1) % 26 + 1 AS INTEGER), 1) || ')' END AS marker FROM s""")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    p = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("pos"), (F.col("l_suppkey") % 4).alias("num_id"), (F.col("l_linenumber") % 3).alias("lvl"))
    d = lambda fmt, text, start: F.struct(F.lit(fmt).alias("fmt"), F.lit(text).alias("text"), F.lit(start).alias("start"))
    defs = F.create_map(F.lit(0), d("decimal", "%1.", 5), F.lit(1), d("decimal", "%1.%2", 1), F.lit(2), d("lowerLetter", "(%3)", 1))
    # All four list ids share one definition, so they count on together.
    lists = t.supplier.select((F.col("s_suppkey") % 4).alias("num_id")).distinct().select(
        "num_id", F.lit("base").alias("abs_id"), defs.alias("defs"), F.lit(None).cast("map<int,int>").alias("overrides"))
    return ds.number_paragraphs(p, lists, levels=3).select("doc_id", "pos", "marker")


@query("nst3_style_inheritance", """WITH RECURSIVE c AS (SELECT p_partkey AS style, p_partkey AS at_, 0 AS d FROM part UNION ALL SELECT c.style, c.at_ // 2, d + 1 FROM c WHERE c.at_ // 2 > 0 AND d < 19)
    SELECT c.style, CAST(arg_min(p_size, d) FILTER (at_ % 3 = 0) AS INTEGER) AS sz, CAST(arg_min(at_ % 6 + 1, d) FILTER (at_ % 5 = 0) AS INTEGER) AS heading FROM c JOIN part p ON p.p_partkey = c.at_ GROUP BY c.style""")
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("Heading "), (k % 6 + 1).cast("string"))).otherwise("Body")
    s = t.part.select(k.alias("style"), F.expr("nullif(p_partkey div 2, 0)").alias("based_on"), F.when(k % 3 == 0, F.col("p_size")).alias("sz"),
                      ds.heading_of(name, F.lit(None).cast("int")).alias("heading"))
    return ds.inherit_styles(s, ["sz", "heading"]).select("style", "sz", "heading")


cte("runs", """SELECT doc_id, pos, unnest(string_split(line, ' ')) AS t, unnest(range(len(string_split(line, ' ')))) AS run FROM lines""", "lines")


def _runs(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "pos", F.posexplode(F.split("line", " ", -1)).alias("run", "t"))


@query("nst1_merged_runs", with_("runs", """SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(min(run) AS INTEGER) AS run, b, string_agg(t, '' ORDER BY run) AS t FROM (
    SELECT *, sum(n) OVER (PARTITION BY doc_id, pos ORDER BY run) AS g FROM (SELECT *, CASE WHEN b = lag(b) OVER (PARTITION BY doc_id, pos ORDER BY run) THEN 0 ELSE 1 END AS n
      FROM (SELECT *, (doc_id + run) % 4 < 2 AS b FROM runs WHERE t <> ''))) GROUP BY doc_id, pos, g, b"""))
def _(t: Tables) -> DataFrame:
    r = _runs(t).withColumn("b", (F.col("doc_id") + F.col("run")) % 4 < 2)
    return ds.merge_runs(r, ["b"], ["doc_id", "pos"]).select("doc_id", "pos", "run", "b", "t")


@query("nst2_trimmed_runs", with_("runs", """SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(run AS INTEGER) AS run, CASE WHEN run = a AND run = b THEN t WHEN run = a THEN t || ' ' WHEN run = b THEN ' ' || t ELSE ' ' || t || ' ' END AS t FROM (
    SELECT *, min(run) FILTER (t <> '') OVER w AS a, max(run) FILTER (t <> '') OVER w AS b FROM runs WINDOW w AS (PARTITION BY doc_id, pos)) WHERE run BETWEEN a AND b"""))
def _(t: Tables) -> DataFrame:
    r = _runs(t).withColumn("t", F.concat(F.lit(" "), "t", F.lit(" ")))
    return ds.trim_runs(r, ["doc_id", "pos"])


@query("wn19_running_parts", with_("lines", f"""SELECT doc_id, CAST(min(pos) AS INTEGER) AS ord, x AS text FROM (SELECT doc_id, pos, trim(line) AS x FROM lines) WHERE x <> '' AND NOT regexp_matches(x, '(?i)^(\\d+|of)$') GROUP BY doc_id, x"""))
def _(t: Tables) -> DataFrame:
    b = lines(t).select("doc_id", F.lit("header").alias("part"), F.col("pos").alias("ord"), F.lit("p").alias("kind"), F.col("line").alias("text"))
    return ds.dedupe_parts(b).select("doc_id", "ord", "text")


@query("wn20_footnote_order", with_("lines", """SELECT doc_id, CAST(id AS INTEGER) AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r NULLS LAST, id) AS INTEGER) AS n FROM (
    SELECT l.doc_id, l.pos AS id, r.r FROM lines l LEFT JOIN (SELECT doc_id, h % 7 AS id, min(pos) AS r FROM lines GROUP BY ALL) r ON r.doc_id = l.doc_id AND r.id = l.pos WHERE trim(l.line) <> '')"""))
def _(t: Tables) -> DataFrame:
    ln = lines(t)
    refs = ln.select("doc_id", (F.col("h") % 7).cast("int").alias("id"), "pos")
    return ds.order_footnotes(ln.select("doc_id", F.col("pos").alias("id"), F.col("line").alias("text")), refs).select("doc_id", "id", "n")


@query("wn21_accepted_marks", with_("lines", """SELECT doc_id, CAST(max(pos) AS INTEGER) AS pos, string_agg(line, '' ORDER BY pos) AS text FROM (
    SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM (
      SELECT *, CASE WHEN h % 3 = 1 AND coalesce(lead(tr) OVER w = false, false) AND NOT tr THEN 0 ELSE 1 END AS e FROM (
        SELECT *, contains(line, ' | ') AS tr FROM lines) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))) GROUP BY doc_id, g"""))
def _(t: Tables) -> DataFrame:
    p = lines(t).select("doc_id", "pos", F.when(F.contains("line", F.lit(" | ")), "tr").otherwise("p").alias("kind"), F.col("line").alias("text"),
                        (F.col("h") % 3 == 1).alias("mark_deleted"), F.lit(False).alias("ends_section"), (F.col("line") != "").alias("has_content"))
    return ds.accept_marks(p).select("doc_id", "pos", "text")


@query("ag29_prior_revisions", "SELECT l_orderkey AS doc_id, count(*) FILTER (l_tax > 0.03) AS revisions FROM lineitem GROUP BY l_orderkey")
def _(t: Tables) -> DataFrame:
    return ds.count_revisions(t.lineitem.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_tax") > 0.03).alias("has_content")))


# ---- pages --------------------------------------------------------------------------------------------

def _tiles(t: Tables, side: int) -> DataFrame:
    """A vector is a grey page of eight lines in one tile, the even ones side a, the odd ones side b."""
    grey = lambda v: F.struct(*[(v.cast("double") * 255).alias(c) for c in "rgb"])
    return t.embeddings.filter(F.col("vec_id") % 2 == side).select(
        F.expr("vec_id div 2 div 10").alias("pair_id"), F.expr("vec_id div 2 % 10").alias("page"), F.lit(0).alias("ty"), F.lit(0).alias("tx"),
        F.lit(8).alias("w"), F.transform("embedding", grey).alias("px"))


cte("px", """SELECT pair_id, page, y, x, d * d * 0.5053 > 35215.0 * 0.04 AS differs FROM (
    SELECT a.vec_id // 2 // 10 AS pair_id, a.vec_id // 2 % 10 AS page, k // 8 AS y, k % 8 AS x, (CAST(a.embedding[k + 1] AS DOUBLE) - CAST(b.embedding[k + 1] AS DOUBLE)) * 255 AS d
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(64) r(k) WHERE a.vec_id % 2 = 0 AND k < len(a.embedding))""")
cte("pg", "SELECT pair_id, page, page % 4 = 3 AS b_missing, count(*) FILTER (differs) * 100.0 / count(*) AS p FROM px GROUP BY ALL", "px")
PCT = "CASE WHEN b_missing THEN 100.0 ELSE p END"


def _diff(t: Tables, threshold: float = 0.2) -> DataFrame:
    return pg.differing_tiles(_tiles(t, 0), _tiles(t, 1), threshold)


def _page_diffs(t: Tables) -> DataFrame:
    a, b = _tiles(t, 0), _tiles(t, 1).filter("page % 4 <> 3")
    return pg.page_differences(_diff(t), pg.pair_pages(a, b))


@query("jn28_page_pairs", with_("pg", "SELECT pair_id, page, false AS a_missing, b_missing FROM pg"))
def _(t: Tables) -> DataFrame:
    return pg.pair_pages(_tiles(t, 0), _tiles(t, 1).filter("page % 4 <> 3"))


@query("jn29_differing_pixels", with_("px", "SELECT pair_id, page, count(*) FILTER (differs) AS n FROM px GROUP BY ALL"))
def _(t: Tables) -> DataFrame:
    return _diff(t).groupBy("pair_id", "page").agg(F.sum("n_differs").cast("long").alias("n"))


@query("ag21_page_difference", with_("pg", f"SELECT pair_id, page, round({PCT}, 6) AS pct FROM pg"))
def _(t: Tables) -> DataFrame:
    return _page_diffs(t).select("pair_id", "page", F.round("pct", 6).alias("pct"))


FAR = 0.6  # few pixels of two vectors are that far apart, so that a page has several areas


@query("ag22_difference_boxes", """WITH RECURSIVE c AS (SELECT pair_id, page, y, x FROM (SELECT a.vec_id // 2 // 10 AS pair_id, a.vec_id // 2 % 10 AS page, k // 8 AS y, k % 8 AS x,
        (CAST(a.embedding[k + 1] AS DOUBLE) - CAST(b.embedding[k + 1] AS DOUBLE)) * 255 AS d
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(64) r(k) WHERE a.vec_id % 2 = 0 AND k < len(a.embedding)) WHERE d * d * 0.5053 > 35215.0 * 0.36),
    reach AS (SELECT pair_id, page, y * 8 + x AS first, y, x FROM c
      UNION SELECT r.pair_id, r.page, r.first, c.y, c.x FROM reach r JOIN c ON c.pair_id = r.pair_id AND c.page = r.page AND abs(c.y - r.y) <= 2 AND abs(c.x - r.x) <= 2),
    area AS (SELECT pair_id, page, y, x, min(first) AS area FROM reach GROUP BY ALL),
    box AS (SELECT pair_id, page, area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM area GROUP BY ALL)
    SELECT pair_id, page, CAST(row_number() OVER (PARTITION BY pair_id, page ORDER BY area) - 1 AS INTEGER) AS box, (x0 - 3) / 8.0 AS x, (y0 - 3) / 8.0 AS y,
      (x1 - x0 + 7) / 8.0 AS bw, (y1 - y0 + 7) / 8.0 AS bh FROM box""")
def _(t: Tables) -> DataFrame:
    sizes = _tiles(t, 0).select("pair_id", "page", F.lit(8).alias("w"), F.lit(8).alias("h"))
    return pg.difference_boxes(_diff(t, FAR), sizes, grid=1)


@query("ag27_page_verdicts", with_("pg", f"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN b_missing THEN 'missing' WHEN p < 60 AND page % 3 = 0 THEN 'suspect' WHEN p < 60 THEN 'same' ELSE 'differs' END AS verdict FROM pg) GROUP BY verdict"""))
def _(t: Tables) -> DataFrame:
    """Pages below 60 % count as equal here, as no two vectors are."""
    d = _page_diffs(t).withColumn("pct", F.when(F.col("pct") < 60, 0.0).otherwise(F.col("pct")))
    return pg.page_verdicts(d, d.filter("page % 3 = 0")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("prj13_page_range", with_("pg", "SELECT pair_id, max(page) AS pages, max(page) > 300 AS needs_range, round(max(page) * 0.4, 6) AS image_seconds, round(max(page) * 8.0, 6) AS ocr_seconds FROM pg WHERE page BETWEEN 2 AND 8 GROUP BY pair_id"))
def _(t: Tables) -> DataFrame:
    p = pg.page_plan(pg.restrict_pages(_tiles(t, 0), 2, 8))
    return p.select("pair_id", "pages", "needs_range", F.round("image_seconds", 6).alias("image_seconds"), F.round("ocr_seconds", 6).alias("ocr_seconds"))


@query("ag20_page_confidence", with_("lines", """SELECT doc_id, CAST(coalesce(floor(avg(CASE WHEN c >= 0 THEN c END) + 0.5), -1) AS BIGINT) AS avg_conf, count(*) FILTER (c >= 0 AND c < 80) AS low_pages
    FROM (SELECT doc_id, h % 111 - 10 AS c FROM lines) GROUP BY doc_id"""))
def _(t: Tables) -> DataFrame:
    return pg.confidence(lines(t).select("doc_id", (F.col("h") % 111 - 10).alias("conf")))


@query("str13_cleaned_recognition", with_("lines", """SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(line) || chr(10) || chr(10) || '中文x' AS text FROM lines WHERE trim(line) <> ''"""))
def _(t: Tables) -> DataFrame:
    ln = lines(t).filter("trim(line) <> ''")
    return ln.select("doc_id", "pos", T.clean_ocr(F.concat(F.lit(" "), "line", F.lit("  \n\n\n\n中 \t文x "))).alias("text"))


@query("str14_stitched_pages", with_("lines", """SELECT doc_id, string_agg(CASE WHEN n > 1 THEN '—— Page ' || p || ' ——' || chr(10) ELSE '' END || t, chr(10) || chr(10) ORDER BY p) AS text FROM (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id) AS n, string_agg(w, chr(10) ORDER BY pos) AS t FROM (SELECT doc_id, pos, pos // 20 + 1 AS p, 'w' || length(line) AS w FROM lines) GROUP BY doc_id, p) GROUP BY doc_id"""))
def _(t: Tables) -> DataFrame:
    ln = lines(t).select("doc_id", "pos", F.expr("pos div 20 + 1").alias("page"), F.concat(F.lit("w"), F.length("line").cast("string")).alias("w"))
    p = ln.groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "w"))).getField("w"), " \n").alias("text"))
    return pg.stitch_pages(p)


@query("wn23_low_confidence_words", with_("lines", """, ws AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, pos // 20 ORDER BY pos) - 1 AS ln, string_split(line, ' ') AS w FROM lines),
    x AS (SELECT doc_id, pos, ln, w[i] AS w, CAST(coalesce(sum(len(w[i]) + 1) OVER (PARTITION BY doc_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS f FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ws))
    SELECT doc_id, pos // 20 + 1 AS page, CAST(ln AS INTEGER) AS line, f AS "from", CAST(f + len(w) AS INTEGER) AS "to" FROM x WHERE w <> '' AND (len(w) * 37 + pos * 11) % 101 < 70"""))
def _(t: Tables) -> DataFrame:
    ln = lines(dealt(t)).withColumn("page", F.expr("pos div 20 + 1"))
    word = F.transform(F.split("line", " "), lambda w: F.struct(w.alias("w"), ((F.length(w) * 37 + F.col("pos") * 11) % 101).alias("conf")))
    p = ln.withColumn("ws", word).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "ws"))).alias("z"))
    return pg.low_positions(p.select("doc_id", "page", F.array_join("z.line", "\n").alias("text"), F.flatten("z.ws").alias("words")))
