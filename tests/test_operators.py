"""Literal cases of single operators, a streaming run, and the registry against its SQL."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import oracle_check  # noqa: E402

from palimpsest.functions import numbers as N, text as T  # noqa: E402
from palimpsest.operators import docstruct as ds, fingerprint as fp, pages as pg  # noqa: E402
from palimpsest.sources import files as sf  # noqa: E402
from palimpsest.streaming import jobs as sj  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_chinese_numbers_and_clauses(spark):
    for s, v in (("十二", 12), ("一百二十", 120), ("三万五千", 35000), ("两", 2), ("甲", None)):
        assert one(spark, N.parse_zh_number(F.lit(s))) == v
    assert one(spark, N.parse_num(F.lit("3.5 万"))) == 35000
    assert one(spark, T.clause_title(F.lit("第 三 条 付款方式，按月"), F.lit("p"))) == "第 三 条 付款方式，按月"
    assert one(spark, T.word_tokens(F.lit("合同 120,000 元，Company’s été"))) == \
        ["合", "同", " ", "120", ",", "000", " ", "元", "，", "Company’s", " ", "été"]
    assert one(spark, T.is_page_number(F.lit("第 3 页"))) and not one(spark, T.is_page_number(F.lit("第 3 条")))


def test_ordinals_are_no_risk(spark):
    h = N.number_at(F.lit("见第 3 条"), F.lit(3), F.lit(4))
    assert one(spark, N.is_ordinal(h))
    d = N.date_at(F.lit("于 2026年2月30日 生效"), F.lit(2), F.lit(3))
    assert str(one(spark, d["d"])) == "2026-03-02"


def test_encodings(spark):
    rows = [(1, "合同金额".encode("gb18030")), (2, "plain".encode()), (3, "é\x81".encode("latin-1"))]
    got = {r.id: (r.text, r.encoding) for r in sf.decode_text(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert got[1] == ("合同金额", "GB18030 (GBK)") and got[2] == ("plain", "UTF-8")
    assert got[3][1] in ("GB18030 (GBK)", "Big5", "Windows-1252")


def test_pair_names(spark):
    got = one(spark, T.pair_name(F.lit("合作协议-第一轮.docx"), F.lit("合作协议-第三轮.docx")))
    assert (got.common, got.a, got.b) == ("合作协议", "第一轮", "第三轮")


def test_match_equals_all_pairs(spark):
    """The prefix filter loses nothing: hot paragraphs, copies and subsets against brute force."""
    import random
    rnd = random.Random(8)
    docs = {i: frozenset(rnd.choice([1, 2, 3, *range(10, 40)]) for _ in range(rnd.randrange(1, 9))) for i in range(60)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in docs.items()], "cls long, fp array<bigint>")
    got = {(r.doc_cls, r.ver_cls): r.score for r in fp.match_classes(df, df).collect()}
    want = {(d, v): len(docs[d] & docs[v]) / len(docs[v]) for d in docs for v in docs if len(docs[d] & docs[v]) * 2 >= len(docs[v])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_numbering_override_and_bullets(spark):
    p = spark.createDataFrame([(1, 0, 7, 0), (1, 1, 7, 1), (1, 2, 8, 1), (1, 3, 9, 0), (1, 4, 7, 0), (1, 5, 7, 1)], "doc_id int, pos int, num_id int, lvl int")
    d = "map(0, named_struct('fmt','decimal','text','%1.','start',5), 1, named_struct('fmt','lowerRoman','text','%1.%2','start',1))"
    bul = "map(0, named_struct('fmt','bullet','text','','start',1), 1, named_struct('fmt','bullet','text','','start',1))"
    lists = spark.sql(f"select 7 num_id, 'x' abs_id, {d} defs, cast(null as map<int,int>) overrides union all select 8, 'x', {d}, map(1, 4) "
                      f"union all select 9, 'y', {bul}, cast(null as map<int,int>)")
    got = [r.marker for r in ds.number_paragraphs(p, lists, 2).orderBy("pos").collect()]
    assert got == ["5.", "5.i", "5.iv", "•", "6.", "6.i"]


TILES = "pair_id int, page int, ty int, tx int, w int, px array<struct<r:double,g:double,b:double>>"


def test_tiles(spark):
    """The common corner of tiles of unequal width; null pixels and tiles without a partner are not compared."""
    grey = lambda *v: [None if x is None else (float(x),) * 3 for x in v]
    a = spark.createDataFrame([(1, 1, 0, 0, 3, grey(0, 0, 0, 0, 0, 0)), (1, 1, 0, 1, 2, grey(0, None, 9, 255)), (1, 2, 0, 0, 1, grey(0)), (1, 3, 0, 0, 2, [])], TILES)
    b = spark.createDataFrame([(1, 1, 0, 0, 2, grey(0, 255, 255, 0, 255, 255)), (1, 1, 0, 1, 2, grey(255, 255, 9, 9)), (1, 3, 0, 0, 3, [])], TILES)
    got = {(r.page, r.tx): r for r in pg.differing_tiles(a, b).collect()}
    assert got[1, 0].differs == [False, True, True, False] and (got[1, 0].w, got[1, 0].n, got[1, 0].n_differs) == (2, 4, 2)
    assert got[1, 1].differs == [True, None, False, True] and (got[1, 1].n, got[1, 1].n_differs) == (3, 2)
    assert got[3, 0].differs == [] and len(got) == 3
    pages = {r.page: r.pct for r in pg.page_differences(pg.differing_tiles(a, b), pg.pair_pages(a, b)).collect()}
    assert round(pages[1], 6) == round(4 / 7 * 100, 6) and pages[2] == 100.0 and pages[3] == 0.0


def test_boxes(spark):
    tile = lambda ty, tx, *at: (1, 1, ty, tx, 50, [i in at for i in range(2500)], 2500, len(at))
    tiles = spark.createDataFrame([tile(0, 0, 5 * 50 + 5, 5 * 50 + 25), tile(1, 1, 45 * 50 + 45)],
                                  "pair_id int, page int, ty int, tx int, w int, differs array<boolean>, n int, n_differs int")
    size = spark.createDataFrame([(1, 1, 100, 100)], "pair_id int, page int, w int, h int")
    got = pg.difference_boxes(tiles, size, tile=50).orderBy("box").collect()
    assert [(round(r.x, 2), round(r.bw, 2)) for r in got] == [(-0.03, 0.36), (0.87, 0.16)]


def test_areas_as_by_brute_force(spark):
    """Random cells, a spiral and a comb against a walk from cell to cell."""
    import random
    rnd = random.Random(7)
    pages = {k: {(rnd.randrange(60), rnd.randrange(60)) for _ in range(n)} for k, n in enumerate((1, 90, 250, 400))}
    spiral, y, x, step = set(), 0, 0, 48
    for turn, (dy, dx) in enumerate([(0, 1), (1, 0), (0, -1), (-1, 0)] * 8):
        for _ in range(max(step - 3 * turn, 0)):
            spiral.add((y, x))
            y, x = y + dy, x + dx
    pages[8] = spiral
    pages[9] = {(i, j) for i in range(40) for j in range(0, 40, 3)} | {(40, j) for j in range(40)}
    want = set()
    for page, cells in pages.items():
        left, boxes = set(cells), []
        while left:
            todo = got = [min(left)]
            left -= set(got)
            while todo:
                near = {(a, b) for a, b in left if any(abs(a - c) <= 2 and abs(b - d) <= 2 for c, d in todo)}
                left -= near
                todo = list(near)
                got = got + todo
            boxes.append((min(got), min(b for _, b in got), min(a for a, _ in got), max(b for _, b in got), max(a for a, _ in got)))
        want |= {(page, n, *box[1:]) for n, box in enumerate(sorted(boxes))}
    cells = spark.createDataFrame([(1, p, a, b) for p, c in pages.items() for a, b in c], "pair_id int, page int, gy int, gx int")
    assert {tuple(r)[1:] for r in pg.areas(cells).collect()} == want
    assert pg.areas(cells.limit(0)).count() == 0


def test_stream_of_decisions(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = sj.DECISION
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([(1, 1, "a", 9, "2026-01-02", 2), (1, 2, "h", 9, "2026-01-01", 1)])
    run = lambda: sj.follow_decisions(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp"), once=True).awaitTermination()
    run()
    put([(1, 1, "r", 9, "2026-01-01", 0), (1, 2, "r", 9, "2026-01-03", 3)])
    run()
    got = {r.change: r.v for r in sj.current_decisions(sj.read_store(spark, store, schema)).collect()}
    assert got == {1: "a", 2: "r"}


FAST = ["src2_line_facts", "prj2_block_keys", "ag2_dice", "jn12_overlap_join", "jn13_best_version", "jn21_prior_hints", "wn2_edit_segments",
        "jn16_attached_decisions", "jn24_comment_anchors", "wn13_gap_breaks", "wn17_list_numbers", "red2_result_text", "st3_decision_log"]


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    import __spark_entry__ as e
    assert oracle_check.compare(spark, oracle_check.duck(FOLDER), FOLDER, name, e.queries()[name], e.oracle_sql()[name]) == ""


def test_registry_is_consistent():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 180


def test_lines_from_items(spark):
    """Tabs, blanks, ideographs, raised references, white-space items and lines by their baselines."""
    from palimpsest.operators import layout as la
    items = [
        (1, 1, 0, " ", 10.0, 700.0, 10.0, 3.0),            # white space before any text: nothing
        (1, 1, 1, "Fees", 72.0, 700.0, 10.0, 20.0), (1, 1, 2, "due", 95.0, 700.4, 10.0, 15.0),   # a blank
        (1, 1, 3, "now", 111.0, 700.0, 10.0, 15.0),                                              # too close for a blank
        (1, 1, 4, "1", 126.5, 704.0, 6.0, 3.0), (1, 1, 5, "2", 129.5, 704.0, 6.0, 3.0),          # one raised reference
        (1, 1, 6, "USD", 160.0, 700.0, 11.0, 15.0),                                              # a tab
        (1, 1, 7, " ", 175.0, 640.0, 10.0, 3.0),                                                 # white space elsewhere
        (1, 1, 8, "合同", 72.0, 686.0, 10.0, 20.0), (1, 1, 9, "条款", 95.0, 686.0, 10.0, 20.0),    # no blank
        (1, 1, 10, " ", 115.0, 686.0, 10.0, 20.0), (1, 1, 11, "12", 135.0, 686.0, 10.0, 10.0),   # a wide white-space item
        (1, 1, 12, "left", 20.0, 686.0, 10.0, 20.0),                                             # same baseline, back to the left
        (1, 2, 0, "next", 72.0, 686.0, 10.0, 20.0), (1, 2, 1, "", 0.0, 0.0, 1.0, 0.0),
        (2, 1, 0, " ", 0.0, 0.0, 1.0, 1.0), (3, 1, 0, None, 1.0, 1.0, 1.0, 1.0),
        (4, 1, 0, "lost", None, None, 10.0, None), (4, 1, 1, "x", 72.0, 700.0, 10.0, 5.0),
    ]
    schema = "doc_id long, page int, ix int, str string, x double, y double, size double, width double"
    got = la.assemble_lines(spark.createDataFrame(items, schema)).orderBy("doc_id", "line").collect()
    assert [(r.doc_id, r.page, r.line, r.text, r.cols, r.size) for r in got] == [
        (1, 1, 0, "Fees duenow\tUSD", True, 11.0), (1, 1, 1, "合同条款\t12", True, 10.0), (1, 1, 2, "left", False, 10.0),
        (1, 2, 3, "next", False, 10.0), (4, 1, 0, "lost", False, 10.0), (4, 1, 1, "x", False, 10.0)]
    assert [r.text for r in got[0].runs] == ["Fees", " due", "now", "\tUSD"] and got[0].x == 72.0 and got[0].end_x == 175.0
    assert la.assemble_lines(spark.createDataFrame([], schema)).count() == 0
