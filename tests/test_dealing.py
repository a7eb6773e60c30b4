"""Tokens and list definitions stay where they are: what is shuffled is the text they come from."""

import datetime
import re

import duckdb
import pytest
from pyspark.sql import Row

from palimpsest.operators import docstruct as ds, layout as la, report, tokens
from palimpsest.options import CompareOptions
from palimpsest.plans import compare, registry
from palimpsest.plans.catalog import Tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    docs = [(1, "one two three\nfour | five"), (2, "six seven\n\neight nine ten"), (2, "a second text of that id"), (None, "no id"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["ag2_dice", "ag3_containment", "wn10_token_offsets", "wn24_token_edits"])
def test_only_texts_are_shuffled(spark, folder, name):
    df = registry.QUERIES[name](Tables(spark, folder))
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [line for line in plan if "Exchange" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line and "(doc_id" in line for line in dealt)
    assert df.count()


@pytest.fixture
def foreign(spark):
    """Settings of a session that this library did not build, and no broadcast."""
    own = {"spark.sql.requireAllClusterKeysForCoPartition": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["red1_redline_pieces", "red2_result_text", "wn2_edit_segments", "wn23_low_confidence_words"])
def test_tokens_of_any_session_stay_with_their_text(foreign, folder, name):
    df = registry.QUERIES[name](Tables(foreign, folder))
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [line for line in plan if "Exchange" in line]
    assert moved and all("REPARTITION_BY_NUM" in line and "(doc_id" in line for line in moved)
    assert df.count()


@pytest.mark.parametrize("name", ["jn24_comment_anchors", "jn26_opposite_marks", "jn33_highlight_slices"])
def test_comments_come_to_the_tokens(foreign, tmp_path, name):
    """No token is shuffled, and only lines or pairs with comments are cut into tokens; the rows are those of the SQL."""
    turns = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "c"), (2, 7, "bot", "no such line"), (9, 0, "user", "no such text"), (None, 0, "user", "d")]
    foreign.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    texts = [(1, "one two three four five six\na,b,c,d,e,f,g,h,i,j,k | l\n\nno comment here"), (2, "six seven and so on for some words\nten"), (3, "never discussed"), (None, "no id")]
    foreign.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES[name](Tables(foreign, str(tmp_path)))
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert all(re.search(r"hashpartitioning\((doc_id|pair_id|conv_id)#\d+L?(, turn#\d+L?)?, ", line) for line in plan if "Exchange" in line)
    assert any("LeftSemi" in line for line in plan)
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = duck.execute(registry.ORACLE[name]).fetchall()
    assert df.count() and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_repeated_and_missing_ids_keep_their_tokens(spark, folder):
    got = registry.QUERIES["wn10_token_offsets"](Tables(spark, folder)).filter("side = 'a'").groupBy("pair_id").count().collect()
    assert {r.pair_id: r["count"] for r in got} == {1: 2, 2: 2, None: 1}  # the first lines of both texts are one row


def test_definitions_are_not_carried_through_the_windows(spark):
    d = lambda text, start: Row(fmt="decimal", text=text, start=start)
    lists = spark.createDataFrame([(1, "x", {0: d("%1.", 5), 1: d("%1.%2", 1)}, {0: 9}), (2, "x", {0: d("%1.", 5), 1: d("%1.%2", 1)}, None)],
                                  "num_id int, abs_id string, defs map<int,struct<fmt:string,text:string,start:int>>, overrides map<int,int>")
    paras = spark.createDataFrame([(1, i, n, lvl) for i, (n, lvl) in enumerate([(2, 0), (2, 1), (2, 1), (1, 0), (1, 1), (2, 0)])],
                                  "doc_id int, pos int, num_id int, lvl int")
    out = ds.number_paragraphs(paras, lists, levels=2)
    assert [r.marker for r in out.orderBy("pos").collect()] == ["5.", "5.1", "5.2", "9.", "9.1", "10."]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    deepest = max(i for i, line in enumerate(lines) if "Window [" in line)
    inner = next(line for line in lines[deepest:] if "Project [" in line)
    assert "_start" in inner and not re.search(r"[\[ ]defs#\d+[,\]]", inner)


@pytest.mark.parametrize("name", ["wn11_assembled_lines", "ag23_section_info"])
def test_lines_and_words_stay_with_their_text(spark, folder, name):
    df = registry.QUERIES[name](Tables(spark, folder))
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [line for line in plan if "Exchange" in line and "BroadcastExchange" not in line]
    assert moved and all("REPARTITION_BY_NUM" in line and "(doc_id" in line for line in moved)
    assert df.count()


def test_masks_are_counted_by_page(spark):
    rows = [(1, 0, 1, 800.0, "Deed 1"), (1, 1, 1, 400.0, "Deed 1"), (1, 2, 2, 800.0, "Deed 2"), (1, 3, 2, 799.0, "once"), (1, 4, 3, 800.0, "Deed  3"),
            (1, 5, 3, 798.0, "twice"), (1, 6, 3, 797.0, "twice"), (None, 0, 1, 800.0, "Deed 1"), (None, 1, 2, 800.0, "Deed 2")]
    lines = spark.createDataFrame([(*r, 10.0) for r in rows], "doc_id long, line int, page int, y double, text string, size double")
    got = la.running_heads(lines).filter("doc_id = 1").collect()
    assert {r.line for r in got if r.hf} == {0, 2, 4}


def test_spacing_reads_the_lines_once(spark):
    step = lambda page: [10.5 * (k + 1) if page == 1 else 20.0 * k for k in range(8 if page == 1 else 3)]
    rows = [(d, line, page, 800.0 - down, 10.0, False) for d in (1, None) for line, (page, down) in enumerate((p, y) for p in (1, 2, 3) for y in step(p)[:None if p < 3 else 1])]
    stats = la.spacing_stats(spark.createDataFrame(rows, "doc_id long, line int, page int, y double, size double, cols boolean"))
    assert sorted((r.doc_id, r.page, r.typical, r.source) for r in stats.collect()) == [(1, 1, 1.05, "page"), (1, 2, 1.05, "doc"), (1, 3, None, "fixed")]
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_tokens_of_changed_rows_stay_with_their_row(foreign):
    """Behind the alignment kernels rows are dealt by pair before they are taken apart; no token is shuffled after that."""
    a = foreign.createDataFrame([(1, "one two three\nfour five\nsix"), (2, "seven\neight nine")], "doc_id long, text string")
    b = foreign.createDataFrame([(1, "one 2 three\nsix\nfour five"), (2, "seven\neight 9\nten")], "doc_id long, text string")
    blocks = lambda d: tokens.plain_blocks(d).withColumnRenamed("doc_id", "pair_id")
    out = report.redline_text(compare.compare_merged(blocks(a), blocks(b), CompareOptions(formatting=False)))
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    above = plan[: next(i for i, line in enumerate(plan) if "Generate explode(_m" in line)]
    assert not [line for line in above if "Exchange" in line]
    assert sorted((r.pair_id, r.line) for r in out.collect() if "2" in r.line or "9" in r.line or "ten" in r.line) == [
        (1, "one [-two-][+2+] three"), (2, "[+ten+]"), (2, "eight [-nine-][+9+]")]


def test_lines_of_a_summary_stay_with_their_pair(foreign, tmp_path):
    """The changes are numbered where their pair lies, and what is made of them is joined and put together there."""
    items = [(i, i % 7 + 1, i * 5, i % 3, 10.0 + i, float(i % 9), "ARN"[i % 3], 0.01 * (i % 8), datetime.datetime(2026, 1, 1 + i % 28)) for i in range(60)]
    kinds = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_returnflag string, l_tax double, l_shipdate timestamp"
    foreign.createDataFrame(items, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.QUERIES["snk1_summary_markdown"](Tables(foreign, str(tmp_path)))
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    union = next(i for i, line in enumerate(plan) if "Union" in line)
    assert not [line for line in plan[:union] if "Exchange" in line]
    rows = {r.pair_id: r.summary for r in df.collect()}
    assert set(rows) == {0, 1, 2} and all("- 20 differences in the compared range" in s and "\n20. **" in s for s in rows.values())
