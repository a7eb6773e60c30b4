"""Page images and recognised text: page pairs, pixel differences, boxes, confidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.session import written

# ---- fixed values -----------------------------------------------------------
MAX_DELTA = 35215.0
SAME_PCT = 0.001
LOW_CONF, WORD_CONF = 80, 70
BIG_PAGES = 300
SECONDS_IMAGE, SECONDS_OCR = 0.4, 8.0
GRID, RADIUS, PAD = 10, 2, 3
# -----------------------------------------------------------------------------
TILE = 320  # side of a whole tile, in pixels


def restrict_pages(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.filter(F.col("page").between(first, last))


def page_plan(pages: DataFrame) -> DataFrame:
    """Per pair: number of pages, whether a range must be chosen, estimated seconds per mode."""
    n = F.max("page")
    return pages.groupBy("pair_id").agg(n.alias("pages")).withColumn("needs_range", F.col("pages") > BIG_PAGES) \
        .withColumn("image_seconds", F.col("pages") * SECONDS_IMAGE).withColumn("ocr_seconds", F.col("pages") * SECONDS_OCR)


def pair_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """pages(pair_id, page, a_missing, b_missing) of two page lists."""
    l = a.select("pair_id", "page").distinct().withColumn("_a", F.lit(True))
    r = b.select("pair_id", "page").distinct().withColumn("_b", F.lit(True))
    return l.join(r, ["pair_id", "page"], "full_outer").select(
        "pair_id", "page", F.col("_a").isNull().alias("a_missing"), F.col("_b").isNull().alias("b_missing"))


def color_delta(r1: Column, g1: Column, b1: Column, r2: Column, g2: Column, b2: Column) -> Column:
    """Squared perceived distance of two colours in YIQ space."""
    dr, dg, db = r1 - r2, g1 - g2, b1 - b2
    y = dr * 0.29889531 + dg * 0.58662247 + db * 0.11448223
    i = dr * 0.59597799 - dg * 0.27417610 - db * 0.32180189
    q = dr * 0.21147017 - dg * 0.52261711 + db * 0.31114694
    return y * y * 0.5053 + i * i * 0.299 + q * q * 0.1957


PT = ["pair_id", "page"]


def differing_tiles(a: DataFrame, b: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Tiles of page images compared: adds ``differs``, row by row whether the colours of the common pixels
    differ by more than the threshold, ``w``, its width, and ``n``, ``n_differs``, the pixels compared and differing.

    Tiles: pair_id, page, ty, tx (place in the tiling), w, px (array of r, g, b, row by row, w to a row). One row
    per tile is shuffled, whatever its pixels. Only what both sides have is compared: where widths differ (the
    last tiles of a page) the common corner, null pixels and missing tiles never.
    """
    o = b.select(*PT, "ty", "tx", F.col("w").alias("w2"), F.col("px").alias("px2"))
    t = a.select(*PT, "ty", "tx", F.col("w").alias("w1"), F.col("px").alias("px1")).join(o, [*PT, "ty", "tx"])

    def differs(p: Column, q: Column) -> Column:
        return color_delta(p["r"], p["g"], p["b"], q["r"], q["g"], q["b"]) > MAX_DELTA * threshold * threshold

    t = t.withColumn("w", F.least("w1", "w2"))
    rows = F.least(F.ceil(F.size("px1") / F.col("w1")), F.ceil(F.size("px2") / F.col("w2"))).cast("int")
    cut = lambda px, width: F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.slice(px, r * F.col(width) + 1, F.col("w"))))
    alike = F.zip_with("px1", "px2", differs)
    corner = F.when(rows > 0, F.zip_with(cut(F.col("px1"), "w1"), cut(F.col("px2"), "w2"), differs)).otherwise(F.array().cast("array<boolean>"))
    t = t.withColumn("differs", F.when(F.col("w1") == F.col("w2"), alike).otherwise(corner))
    count = lambda keep: F.size(F.filter("differs", keep))
    return t.select(*PT, "ty", "tx", "w", "differs", count(lambda d: d.isNotNull()).alias("n"), count(lambda d: d).alias("n_differs"))


def page_differences(tiles: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``pct`` to page pairs from compared tiles; a missing page differs by 100 %."""
    n = tiles.groupBy(*PT).agg((F.try_divide(F.sum("n_differs"), F.sum("n")) * 100).alias("pct"))
    return pages.join(n, PT, "left").withColumn(
        "pct", F.when(F.col("a_missing") | F.col("b_missing"), 100.0).otherwise(F.coalesce("pct", F.lit(0.0))))


def differing_cells(tiles: DataFrame, grid: int = GRID, tile: int = TILE) -> DataFrame:
    """cells(pair_id, page, gy, gx): cells of the page's grid with a differing pixel; ``tile`` is the side of whole tiles."""
    at = F.filter(F.transform("differs", lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    cell = lambda i: F.struct(F.floor((F.col("ty") * tile + F.floor(i / F.col("w"))) / grid).cast("int").alias("gy"),
                              F.floor((F.col("tx") * tile + i % F.col("w")) / grid).cast("int").alias("gx"))
    t = tiles.filter("n_differs > 0").select(*PT, F.explode(F.array_distinct(F.transform(at, cell))).alias("c"))
    return t.select(*PT, "c.gy", "c.gx").distinct()


def _settled_links(links: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (pair_id, page, u, v) to links of every node to the smallest one of its area, in rounds that hang
    the neighbours of each node below its smallest neighbour: first the larger ones, then the smaller ones."""
    def hang(l: DataFrame, larger: bool) -> DataFrame:
        both = l.unionByName(l.select(*PT, F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if larger else both.filter("v < u")
        m = F.least(F.col("u"), F.min("v").over(Window.partitionBy(*PT, "u")))
        near = near.withColumn("m", m)
        kept = near.filter("v > u") if larger else near.unionByName(near.withColumn("v", F.col("u")))
        return kept.filter("v <> m").select(*PT, F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    print_of = lambda l: l.agg(F.count("*"), F.sum(F.xxhash64(*PT, "u", "v").cast("decimal(38,0)"))).first()
    now = cut(links.select(*PT, "u", "v").distinct())
    before, seen = None, print_of(now)
    while seen != before:
        now = cut(hang(hang(now, True), False))
        before, seen = seen, print_of(now)
    return now


def areas(cells: DataFrame, radius: int = RADIUS, cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """areas(pair_id, page, box, x0, y0, x1, y1) in cells: cells up to ``radius`` apart in both directions belong
    together. ``box`` numbers the areas of a page in the reading order of their first cells; nothing is cut off.

    Cells of a row are first united to runs, runs of near rows are linked, and links are followed in tables, so
    that no page is held by one task; the rounds grow with the logarithm of the longest way through an area.
    """
    row = Window.partitionBy(*PT, "gy").orderBy("gx")
    t = cells.withColumn("new", F.when(F.col("gx") - F.lag("gx").over(row) <= radius, 0).otherwise(1))
    t = t.withColumn("run", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = t.groupBy(*PT, "gy", "run").agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"))
    # A run is named by its first cell, in reading order.
    runs = cut(runs.select(*PT, "gy", "x0", "x1", (F.col("gy").cast("long") * 2**32 + F.col("x0")).alias("u")))
    near = runs.select(*PT, F.explode(F.array(*[F.col("gy") + k for k in range(1, radius + 1)])).alias("gy"),
                       F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("u").alias("v"))
    links = runs.join(near, [*PT, "gy"]).filter((F.col("x0") <= F.col("_x1") + radius) & (F.col("_x0") <= F.col("x1") + radius))
    first = _settled_links(links, cut).withColumnRenamed("v", "area")
    t = runs.join(first, [*PT, "u"], "left").withColumn("area", F.coalesce("area", "u"))
    got = t.groupBy(*PT, "area").agg(F.min("x0").alias("x0"), F.min("gy").alias("y0"), F.max("x1").alias("x1"), F.max("gy").alias("y1"))
    box = F.row_number().over(Window.partitionBy(*PT).orderBy("area")) - 1
    return got.select(*PT, box.alias("box"), "x0", "y0", "x1", "y1")


def difference_boxes(tiles: DataFrame, sizes: DataFrame, grid: int = GRID, tile: int = TILE) -> DataFrame:
    """boxes(pair_id, page, box, x, y, bw, bh): the areas of differing cells, relative to the page (sizes: pair_id,
    page, w, h in pixels), padded by three pixels."""
    got = areas(differing_cells(tiles, grid, tile))
    side = lambda lo, hi, n: (((F.col(lo) * grid - PAD) / F.col(n)), (((F.col(hi) - F.col(lo) + 1) * grid + 2 * PAD) / F.col(n)))
    (x, w), (y, h) = side("x0", "x1", "w"), side("y0", "y1", "h")
    return got.join(sizes, PT).select(*PT, "box", x.alias("x"), y.alias("y"), w.alias("bw"), h.alias("bh"))


def page_verdicts(diffs: DataFrame, unread: DataFrame) -> DataFrame:
    """Adds verdict: missing / same / suspect (same, but the page has unreadable text) / differs."""
    u = unread.select("pair_id", "page").distinct().withColumn("_u", F.lit(True))
    same = F.col("pct") < SAME_PCT
    return diffs.join(u, ["pair_id", "page"], "left").withColumn("verdict", (
        F.when(F.col("a_missing") | F.col("b_missing"), "missing").when(same & F.col("_u").isNotNull(), "suspect").when(same, "same")
        .otherwise("differs"))).drop("_u")


def confidence(pages: DataFrame) -> DataFrame:
    """Per document: mean page confidence (rounded half up, -1 without pages read), low pages."""
    read = F.when(F.col("conf") >= 0, F.col("conf"))
    return pages.groupBy("doc_id").agg(
        F.coalesce(F.floor(F.avg(read) + 0.5), F.lit(-1)).cast("long").alias("avg_conf"),
        F.count_if((F.col("conf") >= 0) & (F.col("conf") < LOW_CONF)).alias("low_pages"))


def stitch_pages(pages: DataFrame) -> DataFrame:
    """One text per document from its recognised pages, with a head line per page if there are several."""
    n = F.count("*")
    line = F.concat(F.lit("—— Page "), F.col("page").cast("string"), F.lit(" ——\n"))
    g = pages.groupBy("doc_id").agg(n.alias("n"), F.array_sort(F.collect_list(F.struct(
        "page", T.clean_ocr(F.col("text")).alias("t"), line.alias("h")))).alias("p"))
    body = F.transform("p", lambda x: F.when((F.col("n") > 1) | (x["page"] > 1), F.concat(x["h"], x["t"])).otherwise(x["t"]))
    return g.select("doc_id", F.array_join(body, "\n\n").alias("text"))


def _forward_hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Finds each page's words one after another and gives the unsure ones as line and columns."""
    for batch in batches:
        out = []
        for doc, page, text, words, conf in zip(batch["doc_id"], batch["page"], batch["text"], batch["w"], batch["conf"]):
            at = line = start = 0  # cursor; number and start of the line it is in
            for w, c in zip(words, conf):
                hit = text.find(w, at) if w else -1
                if hit < 0:
                    continue
                if breaks := text.count("\n", at, hit):
                    line, start = line + breaks, text.rfind("\n", at, hit) + 1
                if c is not None and c < WORD_CONF:
                    out.append((doc, page, line, hit - start, hit - start + len(w)))
                at = hit + len(w)
                if inner := w.count("\n"):
                    line, start = line + inner, hit + w.rfind("\n") + 1
        yield pd.DataFrame(out, columns=["doc_id", "page", "line", "from", "to"])


def low_positions(pages: DataFrame) -> DataFrame:
    """low(doc_id, page, line, from, to): where words of confidence below 70 stand in the page text.

    pages(doc_id, page, text, words ARRAY<STRUCT<w, conf>>). Words are looked up in order from the end of
    the last hit, however far ahead; one forward pass per page. A word that is not found is left out.
    """
    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    t = pages.where("text is not null and words is not null").select(
        "doc_id", "page", "text", F.transform("words", lambda x: F.coalesce(T.strip_ws(x["w"]), F.lit(""))).alias("w"), F.col("words.conf").alias("conf"))
    return t.mapInPandas(_forward_hits, f"doc_id {kind['doc_id']}, page {kind['page']}, line int, `from` int, `to` int")
