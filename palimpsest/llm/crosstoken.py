"""Alignment of two tokenizers' tokens on the bytes of a text, and how often tokens meet in a corpus.

A is a byte-level BPE (tokenizers file), B a SentencePiece model that puts a blank before a text, so A gets one as
well. Both lists of tokens then cover the same bytes. Every token points to the farthest-right token of the other
side that it overlaps, the one with its last byte; a B token that ends where its A token ends points to itself.
Successor doubling, over all tokens of many documents at once, brings every token to the last one of its component,
which labels its group. A link is an A token and a B token that share a byte.

Texts are encoded once. A's distinct words of many documents are encoded together (merges never leave a word). The
token lists are written to the shared folder; links are derived from them twice, to count id pairs and to give the
counts back to the documents. The most frequent pairs, at most ``MEMO``, go to the workers; what remains is joined.

Defined cases: null and empty texts, and texts whose joined token bytes are not the blank and the text, have no
tokens, hence zeros and an empty string; every row counts, repeated ones as well; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import json
import os
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytebpe import default_pattern, frequent, known_to_java, words_of
from palimpsest.llm.common import saved, text_of

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# They bound a worker's memory only: words encoded and tokens linked at a time, and pairs it keeps.
WORDS, STEP, MEMO = 300_000, 150_000, 1 << 20


# --- vocabularies ------------------------------------------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def bytes_of_a(model: str) -> list[bytes]:
    letters = byte_letters()
    vocab = json.loads(model)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


def bytes_of_b(model: bytes) -> list[bytes]:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


# --- encoding ----------------------------------------------------------------------------------------------------

def _lists(parts: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(parts), np.int32, int(offsets[-1]))))


def _by_words(words: pa.ListArray, encode) -> pa.ListArray:
    """Ids of each row's words, the distinct words of all rows encoded once."""
    ends = words.offsets.to_numpy()
    coded = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    each = _lists(encode(coded.dictionary.to_pylist())).take(coded.indices)
    return pa.ListArray.from_arrays(pa.array(each.offsets.to_numpy()[ends - ends[0]].astype(np.int32)), each.values)


def encode_both(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """Documents (doc_id, text) → (key, doc_id, a, b): packed token ids, empty where the bytes do not agree. Written.

    Ids are packed as little-endian unsigned integers of two bytes (four for vocabularies that need them).
    """
    model_a, model_b = Path(a).read_text(), Path(b).read_bytes()
    sent = docs.sparkSession.sparkContext.broadcast({"a": model_a, "b": model_b, "bytes_a": bytes_of_a(model_a), "bytes_b": bytes_of_b(model_b)})
    java = known_to_java(default_pattern(), docs.select(text_of().alias("t")), "t")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import sentencepiece
        import tokenizers
        tk = tokenizers.Tokenizer.from_str(sent.value["a"])
        tk.encode_special_tokens = True
        sp = sentencepiece.SentencePieceProcessor(model_proto=sent.value["b"])
        bytes_a, bytes_b = pa.array(sent.value["bytes_a"], pa.binary()), pa.array(sent.value["bytes_b"], pa.binary())
        for batch in batches:
            ends = batch.column("words").offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS, side="right")) - 1)
                rows = batch.slice(at, to - at)
                want = pc.binary_join(_binary(rows.column("words")), b"")  # the blank and the text
                texts = pc.utf8_slice_codeunits(want.cast(pa.string()), 1)
                ids_a = _by_words(rows.column("words"), lambda ws: [e.ids for e in tk.encode_batch_fast(ws, add_special_tokens=False)])
                ids_b = _lists(sp.encode(texts.to_pylist(), num_threads=1))
                fine = pc.not_equal(texts, "")
                for ids, of in ((ids_a, bytes_a), (ids_b, bytes_b)):
                    fine = pc.and_(fine, pc.equal(pc.binary_join(pa.ListArray.from_arrays(ids.offsets, of.take(ids.values)), b""), want))
                fine = fine.to_numpy(zero_copy_only=False)
                packed = (_pack(_keep(ids, fine), len(of)) for ids, of in ((ids_a, bytes_a), (ids_b, bytes_b)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *packed], names=["doc_id", "a", "b"])
                at = to
            del batch, rows
    rows = docs.select("doc_id", words_of(F.concat(F.lit(" "), text_of()), java).alias("words"))
    return saved(rows.mapInArrow(run, f"doc_id {kind}, a binary, b binary").withColumn("key", F.monotonically_increasing_id()))


def _binary(words: pa.ListArray) -> pa.ListArray:
    return pa.ListArray.from_arrays(words.offsets, words.values.cast(pa.binary()))


def _keep(ids: pa.ListArray, fine: np.ndarray) -> pa.ListArray:
    """The lists of the rows that are fine, empty ones for the others."""
    ends = ids.offsets.to_numpy()
    sizes = np.diff(ends)
    kept = ids.values.filter(pa.array(np.repeat(fine, sizes)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes * fine))).astype(np.int32)), kept)


def _width(size: int) -> np.dtype:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def _pack(ids: pa.ListArray, size: int) -> pa.BinaryArray:
    kind, ends = _width(size), ids.offsets.to_numpy()
    data = ids.values.to_numpy()[ends[0]:ends[-1]].astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(((ends - ends[0]) * kind.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _unpack(packed: pa.BinaryArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the rows' ids, and all ids."""
    kind = _width(size)
    _, ends, data = packed.buffers()
    ends = np.frombuffer(ends, np.int32)[packed.offset:packed.offset + len(packed) + 1] if len(packed) else np.zeros(1, np.int32)
    return ends // kind.itemsize, np.frombuffer(data, kind) if data is not None and data.size else np.zeros(0, kind)


# --- groups and links --------------------------------------------------------------------------------------------

class Links:
    """Groups and links of some documents' tokens. Bytes are numbered through all documents."""

    def __init__(self, a: np.ndarray, b: np.ndarray, row_a: np.ndarray, row_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        last_b, last_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)  # the tokens with a token's last byte
        n = len(a)
        # nodes: A's tokens, then B's
        closed = end_a[last_a] == end_b if n else np.zeros(0, bool)
        to = np.concatenate((n + last_b, np.where(closed, n + np.arange(len(b)), last_a)))
        while True:
            further = to[to]
            if np.array_equal(further, to):
                break
            to = further
        number = np.cumsum(closed) - 1  # of the group that a B token closes
        self.group_a, self.group_b = number[to[:n] - n], number[to[n:] - n]
        self.row = row_b[closed]  # of each group
        first_b = np.searchsorted(end_b, end_a - size_a[a], side="right")
        count = last_b - first_b + 1
        left = np.repeat(np.arange(n), count)
        right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count - first_b, count)
        self.pair = a[left].astype(np.int64) << 32 | b[right]
        self.pair_row = row_a[left]


def _tables(names: int) -> pa.Array:
    """Ids as text before each of the separators: next id, other side, next group, end."""
    return pa.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(names)])


def group_texts(links: Links, a: np.ndarray, b: np.ndarray, rows: int, texts: pa.Array) -> pa.Array:
    """The groups of each row: ``a1,a2|b1;a3|b2,b3``."""
    group, side = np.concatenate((links.group_a, links.group_b)), np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(group * 2 + side, kind="stable")
    ids, group, side = np.concatenate((a, b))[order], group[order], side[order]
    more = np.diff(group, append=-1) == 0
    mark = np.where(~more, 2, np.where(np.diff(side, append=0) != 0, 1, 0))
    row = links.row[group]
    mark[np.flatnonzero(np.diff(row, append=-1))] = 3
    ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), texts.take(pa.array(mark * (len(texts) // 4) + ids))), "")


def _pieces(batch: pa.RecordBatch, *sizes: int):
    """Parts of a batch of token lists, some ``STEP`` tokens each: first row, rows, and both sides' ids and rows."""
    ends, values = zip(*(_unpack(batch.column(side), size) for side, size in zip("ab", sizes)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends[0], ends[0][at] + STEP, side="right")) - 1)
        ids = [v[e[at]:e[to]].astype(np.int64) for v, e in zip(values, ends)]
        rows = [np.repeat(np.arange(to - at), np.diff(e[at:to + 1])) for e in ends]
        yield at, to - at, *ids, *rows
        at = to


def _sizes(a: str, b: str) -> dict[str, np.ndarray]:
    return {"a": np.array([len(x) for x in bytes_of_a(Path(a).read_text())]), "b": np.array([len(x) for x in bytes_of_b(Path(b).read_bytes())])}


def pair_counts(tokens: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """Token lists → (pair, n, best): links that hold each id pair, and whether no pair of its B id has more. Written.

    A pair is a number: A's id times 2^32 plus B's id.
    """
    sent = tokens.sparkSession.sparkContext.broadcast(_sizes(a, b))

    def run(batches):
        for batch in batches:
            sizes = sent.value["a"], sent.value["b"]
            for _, _, *part in _pieces(batch, *map(len, sizes)):
                pair, n = np.unique(Links(*part, *sizes).pair, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])
            del batch, part
    counts = saved(tokens.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    id_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(id_b.alias("id_b")).agg(F.max("n").alias("top"))
    return saved(counts.withColumn("id_b", id_b).join(top, "id_b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def align_documents(tokens: DataFrame, counts: DataFrame, a: str = A, b: str = B, memo: int = MEMO, groups_as=lambda g: g) -> DataFrame:
    """Token lists and pair counts → (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), a row each.

    ``groups_as`` turns the text of the groups into what is wanted of it, before rows move.
    """
    spark = tokens.sparkSession
    known = frequent(counts, memo).select("pair", "n", "best").toArrow().combine_chunks()  # at most ``memo`` rows
    order = np.argsort(known["pair"].to_numpy(), kind="stable")
    sent = spark.sparkContext.broadcast(_sizes(a, b) | {name: known[name].to_numpy()[order] for name in ("pair", "n", "best")})
    kind = tokens.schema["doc_id"].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches):
        table = sent.value
        size_a, size_b = table["a"], table["b"]
        texts = _tables(max(len(size_a), len(size_b)))
        for batch in batches:
            for at, rows, ids_a, ids_b, row_a, row_b in _pieces(batch, len(size_a), len(size_b)):
                links = Links(ids_a, ids_b, row_a, row_b, size_a, size_b)
                place = np.searchsorted(table["pair"], links.pair)
                hit = np.zeros(len(place), bool)
                inside = place < len(table["pair"])
                hit[inside] = table["pair"][place[inside]] == links.pair[inside]
                ends = np.searchsorted(links.pair_row, np.arange(rows + 1))
                total = [np.zeros(len(place) + 1, np.int64) for _ in range(2)]
                for t, name in zip(total, ("best", "n")):
                    t[1:][hit] = table[name][place[hit]]
                    np.cumsum(t, out=t)
                lost, lost_row = links.pair[~hit], links.pair_row[~hit]
                by = np.lexsort((lost, lost_row))
                lost, lost_row = lost[by], lost_row[by]
                head = np.flatnonzero(np.diff(lost, prepend=-1).astype(bool) | np.diff(lost_row, prepend=-1).astype(bool))
                cut = pa.array(np.searchsorted(lost_row[head], np.arange(rows + 1)).astype(np.int32))
                out = [np.bincount(row_a, minlength=rows), np.bincount(row_b, minlength=rows), np.bincount(links.row, minlength=rows),
                       np.diff(ends), *(np.diff(t[ends]) for t in total)]
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in out), group_texts(links, ids_a, ids_b, rows, texts),
                    pa.ListArray.from_arrays(cut, pa.array(lost[head])), pa.ListArray.from_arrays(cut, pa.array(np.diff(head, append=len(lost)).astype(np.int64)))],
                    names=["key", "doc_id", *numbers, "groups", "rest", "times"])
    found = saved(tokens.select("key", "doc_id", "a", "b")
                  .mapInArrow(run, f"key long, doc_id {kind}, {', '.join(x + ' long' for x in numbers)}, groups string, rest array<long>, times array<long>")
                  .withColumn("groups", groups_as(F.col("groups"))))
    rest = found.select("key", F.explode(F.arrays_zip("rest", "times")).alias("_r")).select("key", F.col("_r.rest").alias("pair"), F.col("_r.times").alias("times"))
    more = (rest.join(counts, "pair").groupBy("key")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")))
    return (found.drop("rest", "times").join(more, "key", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups"))


def digest(groups: Column) -> Column:
    return F.when(groups == "", groups).otherwise(F.sha2(groups, 256))
