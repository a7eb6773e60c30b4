"""Byte-level BPE against the library itself, on texts of every kind."""

import hashlib
import random
import struct
from types import SimpleNamespace

import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from palimpsest.llm import bytebpe, queries

SCHEMA = "doc_id long, text string, words int, ids string, rest string, n long, word string, level int"
PLAIN = tiktoken.Encoding("plain", pat_str=bytebpe.default_pattern(), mergeable_ranks=bytebpe.read_ranks(), special_tokens={})


def texts():
    rng = random.Random(3)
    letters = "etaoinshrdlu ABC éèçñß 019 .,-'\n\t" + "日本語Привет🙂 　\u0085"
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    odd = "".join(chr(c) for c in rng.sample([c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000], 3000))
    newer = "aࡰb 1\U0001E4F05 Ᲊᲊ x\U00010d4a"  # letters and numbers that an older JVM does not know
    return [None, "", " ", "\0", "the", "<|endoftext|> it's we'LL", *some, some[0], odd, newer, "word " * 20_000, "ab" * 300, " " * 500 + "x"]


def rows():
    return [(i, t, 1, "x", None, 3, "w", 0) for i, t in enumerate(texts())] + [(None, "no id", 1, "x", None, 3, "w", 0), (3, "\0", 1, "x", None, 3, "w", 0)]


@pytest.mark.parametrize("memo", [0, 40, 1 << 20])  # everything folded in place, part of it, nothing
def test_ids_as_the_library(spark, memo):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = bytebpe.encode_documents(docs, memo=memo).select("doc_id", "ids", bytebpe.decode_ids(F.col("ids")).alias("back")).collect()
    want = sorted(((i is None, i or 0), PLAIN.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows())
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.ids, bytes(r.back)) for r in got) == want


def test_tokens_the_fold_cannot_reach(spark):
    # no two tokens make up "xyz", so only the word as a whole has its id
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"cd": 258, b"bcd": 259, b"xyz": 300, b"abc": 301}
    spark_encoder = bytebpe.Encoder(ranks)
    words = ["abc", "abcd", "xyz", "xabcdy", "aaab", "ababab", "bcbcd", "q"]
    fold = lambda e: {r.w: r.ids for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", e.word(F.col("w")).alias("ids")).collect()}
    got = fold(spark_encoder)
    assert got["xyz"] == [120, 121, 122]  # no pair leads to it
    spark_encoder.apart = {"xyz": 300}
    got = fold(spark_encoder)
    own = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    assert got == {w: own.encode_ordinary(w) for w in words}


def test_whole_vocabulary(spark):
    enc = bytebpe.encoder(spark)
    assert enc.apart == {}  # every token of this vocabulary is reached


def test_empty_table_and_unknown_id(spark):
    assert bytebpe.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    got = spark.range(1).select(bytebpe.decode_ids(F.array(F.lit(0), F.lit(10 ** 6))).alias("x"), bytebpe.decode_ids(F.array().cast("array<int>")).alias("y")).first()
    assert got.x is None and bytes(got.y) == b""


def test_query_digests(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op13_bytebpe"](spark, folder).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(docs)
    for r in got:
        ids = PLAIN.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_memo_as_it_was_collected():
    """The memo goes to the workers in the pieces it came in, without a copy on the driver."""
    piece = lambda words: pa.table({"word": pa.array(words, pa.string()), "ids": pa.array([[len(w), 7] for w in words], pa.list_(pa.int32()))})
    sent = SimpleNamespace(value=pa.concat_tables([piece(["a", "bb"]), piece([]), piece(["ccc"])]))
    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2, None], "words": [["ccc", "x", "a"], [], ["bb"]]})
    got = pa.Table.from_batches(bytebpe.from_memo([docs], sent)).to_pylist()
    assert got == [{"doc_id": 1, "runs": [[3, 7], [1, 7]], "rest": ["x"]}, {"doc_id": 2, "runs": [[]], "rest": []}, {"doc_id": None, "runs": [[2, 7]], "rest": []}]
