"""Byte-level BPE encoding and decoding by Spark's higher-order functions, with a literal rank map.

A text is cut by the vocabulary's pattern. A word (one match) becomes an array of byte ids, and a fold joins the
neighbours of lowest rank, the leftmost first, until no two neighbours form a token. The ranks are a literal array
of small maps, addressed by a hash of the two ids. Words that are tokens themselves take their own id, as the
library does; only those that the fold would not reach need a map for it.

The corpus decides what is folded beforehand: its distinct words are counted, and the most frequent ones, at most
``MEMO``, are folded once and sent to the workers, which look up the words of many documents at a time. Every other
word is folded where it stands, by the same expression, so the memo changes the time and never the result. Documents
are read twice and never shuffled.

Decoding looks up the bytes of each id and joins them in one pass.

The JVM's Unicode tables may be older than the library's. Code points that the JVM does not know and that occur in
the corpus (usually none) are classified by the library itself and added to the pattern.

Defined cases: null and empty texts have no ids; repeated rows each give their own row; ids keep the order of the
text; an empty table gives an empty result; other columns are neither read nor returned. The time of one word grows
with the square of its own length (a text of many words is linear).
"""

from __future__ import annotations

import base64
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import saved, text_of

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MEMO, BUCKETS, WORDS = 1 << 20, 1 << 16, 1_000_000
# The white space of Unicode (fixed values).
BLANKS = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def java_pattern(pattern: str, letters: str = "", numbers: str = "") -> str:
    """The pattern with Unicode's white space and additional letters and numbers spelled out, for Java."""
    inner = {r"\s": BLANKS, r"\p{L}": r"\p{L}" + letters, r"\p{N}": r"\p{N}" + numbers}
    out, at, bracket = [], 0, False
    for m in re.finditer(r"\\p\{[LN]\}|\\[sS]|\\.|[\[\]]", pattern):
        out.append(pattern[at:m.start()])
        at, token = m.end(), m.group()
        bracket = token == "[" or bracket and token != "]"
        if token == r"\S":
            if bracket:
                raise ValueError("a negated class inside another one is not supported")
            out.append(f"[^{BLANKS}]")
        elif token in inner:
            out.append(inner[token] if bracket else f"[{inner[token]}]")
        else:
            out.append(token)
    return "".join(out) + pattern[at:]


def class_probe(pattern: str):
    """Code point → "L", "N" or "" as the library sees it: whether it stays in one piece with a letter or a number."""
    import tiktoken
    vocab = {bytes([i]): i for i in range(256)} | {bytes([a, b]): 256 * (1 + k) + b for k, a in enumerate(b"a1") for b in range(128, 256)}
    enc = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})
    return lambda c: next((kind for kind, a in (("L", "a"), ("N", "1")) if enc.encode_ordinary(a + c)[0] >= 256), "")


# --- literal maps ------------------------------------------------------------------------------------------------

def _hash(key: bytes) -> int:
    return xxhash.xxh64(key, seed=42).intdigest()


def literal_map(items: dict[str, object], kind: str, buckets: int = BUCKETS) -> tuple[Column, int]:
    """A literal array of small maps: key → bucket by Spark's ``xxhash64`` of the key. One foldable expression."""
    buckets = 1 << max(0, min(buckets, len(items)).bit_length() - 1)
    rows: list[dict[str, object]] = [{} for _ in range(buckets)]
    for key, value in items.items():
        rows[_hash(key.encode()) % buckets][key] = value
    return F.from_json(F.lit(json.dumps(rows, separators=(",", ":"))), f"array<map<string,{kind}>>"), buckets


def look_up(table: tuple[Column, int], key: Column) -> Column:
    """The value of a key, or null."""
    maps, buckets = table
    return F.try_element_at(F.get(maps, F.xxhash64(key).bitwiseAND(F.lit(buckets - 1)).cast("int")), key)


# --- the fold ----------------------------------------------------------------------------------------------------

NONE = chr(0x10FFFF)


def mark(rank: int) -> str:
    """The character that stands for a joined token: in the order of ranks, above the 256 of single bytes."""
    return chr(rank + 0x100 + (0x800 if rank + 0x100 >= 0xD800 else 0))


class Encoder:
    """Ranks of a vocabulary as column expressions.

    A word on its way is a string with one character for each piece: a byte is the character of its value, a joined
    token the one that ``mark`` gives it. So the least character of all possible joins is the one of least rank.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.ranks = ranks
        sign = {token: token.decode("latin-1") if len(token) == 1 else mark(rank) for token, rank in ranks.items()}
        # every way to write a token as two tokens: the pair's characters → the token's
        self.joins = literal_map({sign[t[:i]] + sign[t[i:]]: sign[t] for t in ranks for i in range(1, len(t))
                                  if t[:i] in sign and t[i:] in sign}, "string")
        self.byte_ids = [ranks[bytes([i])] for i in range(256)]
        self.apart: dict[str, int] = {}  # tokens that the fold does not reach

    def fold(self, latin: Column) -> Column:
        """Ids of one word's bytes by ranked merges, one merge every three steps.

        The state holds the pieces ``s``; for each two neighbours the token they would form, ``c``; pairs still to be
        looked up, ``keys``, whose tokens replace ``len`` characters of ``c`` at ``at``; the token ``z`` to form at
        ``at`` next; and what to do: look up (0), choose (1), join (2). Small steps, since interpreted expressions have
        no local variables. Where no two neighbours form a token the state stays as it is.
        """
        def state(s, c, keys, z, at, length, do):
            return F.struct(s.alias("s"), c.alias("c"), keys.alias("keys"), z.alias("z"), at.alias("at"), length.alias("len"), F.lit(do).alias("do"))
        nothing, no_keys, none, zero, one = F.lit(""), F.array().cast("array<string>"), F.lit(NONE), F.lit(0), F.lit(1)

        def step(x: Column, _: Column) -> Column:
            s, c, z, at = x["s"], x["c"], x["z"], x["at"]
            found = F.array_join(F.transform(x["keys"], lambda k: look_up(self.joins, k)), "", NONE)
            least = F.array_min(F.split(c, ""))
            left, right = F.concat(F.substring(s, at - 1, one), z), F.concat(z, F.substring(s, at + 2, one))
            last = at + 1 >= F.char_length(s)
            keys = (F.when(at > 1, F.when(last, F.array(left)).otherwise(F.array(left, right)))
                    .otherwise(F.when(last, no_keys).otherwise(F.array(right))))
            return (F.when(x["do"] == 0, state(s, F.overlay(c, found, at, x["len"]), no_keys, nothing, zero, zero, 1))
                    .when(x["do"] == 1, state(s, c, no_keys, least, F.instr(c, least), zero, 2))
                    .when((z == none) | (z == nothing), x)
                    .otherwise(state(F.overlay(s, z, at, F.lit(2)), c, keys, nothing, F.greatest(at - 1, one), F.when(at > 1, F.lit(3)).otherwise(F.lit(2)), 0)))
        n = F.char_length(latin)
        pairs = F.when(n > 1, F.transform(F.sequence(one, n - 1), lambda i: F.substring(latin, i, one + 1))).otherwise(no_keys)
        ids = lambda x: F.transform(F.split(x["s"], ""), lambda ch: self._id(F.ascii(ch)))
        return F.aggregate(F.sequence(one, n * 3), state(latin, nothing, pairs, nothing, one, zero, 0), step, ids)

    def _id(self, code: Column) -> Column:
        return F.when(code < 256, F.get(F.lit(self.byte_ids), code)).otherwise(code - F.when(code > 0xD800, F.lit(0x900)).otherwise(F.lit(0x100)))

    def word(self, word: Column) -> Column:
        """Ids of one word."""
        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        if not self.apart:
            return self.fold(latin)
        own = look_up(literal_map(self.apart, "int"), latin)
        return F.when(own.isNotNull(), F.array(own)).otherwise(self.fold(latin))


def encoder(spark: SparkSession, path: str = RANKS) -> Encoder:
    """The encoder of a rank file, its unreachable tokens found by folding the whole vocabulary."""
    enc = Encoder(read_ranks(path))
    rows = [(token.decode("latin-1"), rank) for token, rank in enc.ranks.items()]
    tokens = spark.createDataFrame(rows, "token string, rank int").repartition(spark.sparkContext.defaultParallelism)
    enc.apart = {r.token: r.rank for r in tokens.where(F.size(enc.fold(F.col("token"))) > 1).collect()}  # at most the vocabulary
    return enc


# --- documents ---------------------------------------------------------------------------------------------------

def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _counts(docs: DataFrame, pattern: str) -> DataFrame:
    return saved(docs.select(F.explode(words_of(text_of(), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n")))


def known_to_java(pattern: str, texts: DataFrame, column: str) -> str:
    """The pattern for Java that cuts these texts as the library does, whatever code points this JVM does not know."""
    unknown = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(r"\p{Cn}"), F.lit(0)))).alias("c")).distinct()
    found = sorted(r.c for r in unknown.collect())  # at most the code points that this JVM does not know
    kind = class_probe(pattern) if found else None
    more = {k: "".join(rf"\x{{{ord(c):x}}}" for c in found if kind(c) == k) for k in "LN"}
    return java_pattern(pattern, more["L"], more["N"])


def counted_words(docs: DataFrame, pattern: str) -> tuple[DataFrame, str]:
    """Distinct words with their counts, and the pattern for Java that cuts them as the library does."""
    counts = _counts(docs, java_pattern(pattern))
    java = known_to_java(pattern, counts, "word")
    return (counts if java == java_pattern(pattern) else _counts(docs, java)), java


def frequent(counts: DataFrame, most: int = MEMO) -> DataFrame:
    """The words from the smallest count class (an eighth of a doubling) on with which they are ``most`` at most."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()  # some hundred rows
    total, least = 0, None
    for s in sizes:
        total += s.words
        if total > most:
            break
        least = s.level
    return counts.limit(0) if least is None else counts.where(level >= least)


def encode_documents(docs: DataFrame, path: str = RANKS, pattern: str | None = None, memo: int = MEMO) -> DataFrame:
    """Documents (doc_id, text) → (doc_id, ids), a row each."""
    spark = docs.sparkSession
    enc = encoder(spark, path)
    counts, java = counted_words(docs, pattern or default_pattern())
    known = frequent(counts, memo).select("word", enc.word(F.col("word")).alias("ids")).toArrow()  # at most ``memo`` rows
    sent = spark.sparkContext.broadcast(known)  # as it came: the driver makes no copy of it
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (docs.select("doc_id", words_of(text_of(), java).alias("words"))
            .mapInArrow(lambda batches: from_memo(batches, sent), f"doc_id {kind}, runs array<array<int>>, rest array<string>"))
    rest = F.col("rest")
    whole = F.flatten(F.transform("runs", lambda run, i: F.when(i < F.size(rest), F.concat(run, enc.word(F.get(rest, i)))).otherwise(run)))
    return rows.select("doc_id", whole.alias("ids"))


def from_memo(batches, sent):
    """Words of each row → the ids of the known words in runs, and the unknown words that stand between the runs.

    Rows are taken some ``WORDS`` words at a time, which bounds a worker's memory only.
    """
    table = sent.value.combine_chunks()
    known = table.column("word").combine_chunks() if len(table) else pa.array([], pa.string())
    lists = table.column("ids").combine_chunks() if len(table) else pa.array([[0]], pa.list_(pa.int32()))
    starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    for batch in batches:
        words = batch.column("words")
        ends = words.offsets.to_numpy()
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS, side="right")) - 1)
            cut = ends[at:to + 1] - ends[at]
            mine = words.values.slice(ends[at], cut[-1])
            place = pc.fill_null(pc.index_in(mine, known), -1).to_numpy().astype(np.int64)
            lost = np.flatnonzero(place < 0)
            length = np.where(place < 0, 0, starts[place + 1] - starts[place])
            offsets = np.concatenate(([0], np.cumsum(length)))
            ids = flat[np.repeat(starts[place] - offsets[:-1], length) + np.arange(offsets[-1])]
            # a run ends at each unknown word and at the end of each row
            first = np.searchsorted(lost, cut)
            run_ends = np.concatenate(([0], offsets[np.sort(np.concatenate((lost, cut[1:])), kind="stable")]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(at, to - at),
                pa.ListArray.from_arrays(pa.array((first + np.arange(len(cut))).astype(np.int32)),
                                         pa.ListArray.from_arrays(pa.array(run_ends.astype(np.int32)), pa.array(ids))),
                pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), mine.take(pa.array(lost)))], names=["doc_id", "runs", "rest"])
            at = to
        del batch, words, mine


def _by_id(ids: Column, values: list[str | None]) -> Column:
    """The joined hexadecimal values of ids as bytes; null if an id has none."""
    table = F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "", "none"))


def decode_ids(ids: Column, path: str = RANKS) -> Column:
    """Ids → the bytes they stand for (null where an id is not in the vocabulary)."""
    ranks = read_ranks(path)
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    return _by_id(ids, pieces)


def little_endian(ids: Column, size: int) -> Column:
    """Ids below ``size`` as little-endian unsigned 32-bit integers, one after another."""
    return _by_id(ids, [i.to_bytes(4, "little").hex() for i in range(size)])
