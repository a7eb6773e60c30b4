"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

The lattice of a text holds every way to write it in pieces of a given vocabulary; a piece weighs the inverse of its
rank, to the power ``sharpness``, and characters outside the vocabulary become byte pieces. Pieces never run over
the start of a word, so the lattice is a chain of word lattices, built once per distinct word of a batch.

Segmentations are drawn best first by A-star over perturbed log-probabilities. A region of the search holds all
segmentations that leave a known one at some edge; its bound is exact, a Gumbel variable at the region's log-mass,
cut at the value of the segmentation it lies beside. The best region is opened: the edge where to leave is drawn by
mass, then another edge there, and the rest by ancestral sampling; what is left of the region and the region beside
the new segmentation get bounds of their own. The first k values are the k largest perturbed log-probabilities,
hence k distinct segmentations drawn without replacement; the next bound gives each an inclusion score,
1 - exp(-exp(log p - bound)).
All draws come from a counter hash of the row key, so results do not depend on batches or partitions.

Decoding joins the pieces' bytes; it restores every text exactly, U+2581 included (that is written in bytes).

Defined cases: null and empty texts have one segmentation without pieces and inclusion 1; a text with fewer than k
segmentations gives all it has; equal rows give equal samples; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Texts are taken some CHARS at a time, and a lattice of over EDGES is begun anew: both bound a worker's memory only.
SAMPLES, SHARPNESS, CHARS, EDGES = 2, 1.0, 800_000, 1_500_000
# The mark for a blank; a stand-in for that very character in a text; a cut between words. The last two cannot be in a text.
SPACE, OWN, CUT = "▁", "\ud800", "\ud801"
_WORDS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")  # a line feed is a byte piece, so no piece runs over it
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def uniform(key: np.ndarray, at) -> np.ndarray:
    """Uniform numbers in (0, 1) from keys and a counter or counters (a 64-bit finaliser)."""
    with np.errstate(over="ignore"):
        x = key + (np.asarray(at, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53 + 2.0 ** -54


def _hash(codes: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """Extends rolling hashes by one character each."""
    h = np.full(len(codes), 1469598103934665603, np.uint64) if h is None else h
    x = (h ^ codes.astype(np.uint64)) * np.uint64(1099511628211)
    return x ^ (x >> np.uint64(29))


class Vocabulary:
    """Pieces of a SentencePiece model: lookup by hash, log-weights, bytes."""

    def __init__(self, model: bytes, sharpness: float = SHARPNESS):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, sp.unk_id())
        plain = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece runs over the start of a word")
                plain.append((i, piece))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.pieces = pa.array(self.bytes_of, pa.binary())
        self.longest = max(len(p) for _, p in plain)
        self.weight = -sharpness * np.log(np.arange(1.0, len(plain) + 1))
        self.byte_weight = -sharpness * np.log(n + 1.0)
        self.table: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]] = []
        for length in range(1, self.longest + 1):
            of = [(rank, i, p) for rank, (i, p) in enumerate(plain) if len(p) == length]
            codes = np.array([[ord(c) for c in p] for *_, p in of], np.uint32).reshape(len(of), length)
            h = None
            for c in range(length):
                h = _hash(codes[:, c], h)
            h = np.empty(0, np.uint64) if h is None else h
            bits = max(4, (4 * len(of)).bit_length())
            mask = np.uint64((1 << bits) - 1)
            slots = np.full((1 << bits) + 64, -1, np.int32)  # open addressing, a few steps at most
            for j, x in enumerate((h & mask).tolist()):
                while slots[x] >= 0:
                    x += 1
                slots[x] = j
            self.table.append((slots, h, np.array([(r, i) for r, i, _ in of], np.int64).reshape(-1, 2), mask))

    def find(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces of this length, and their (rank, id)."""
        slots, known, what, mask = self.table[length - 1]
        if not len(known):
            return np.empty(0, int), what
        at, rows = (h & mask).astype(np.int64), np.arange(len(h))
        hit, got = [], []
        while len(rows):
            j = slots[at]
            live = j >= 0
            rows, at, j = rows[live], at[live], j[live]
            same = known[j] == h[rows]
            hit.append(rows[same]), got.append(j[same])
            rows, at = rows[~same], at[~same] + 1
        return np.concatenate(hit or [np.empty(0, int)]), what[np.concatenate(got or [np.empty(0, int)])]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


def words_of(text: str) -> list[str]:
    """The lattice's words; without doubled blanks every blank starts one, which a plain split finds faster."""
    if not text:
        return []
    text = SPACE + text.replace(SPACE, OWN).replace(" ", SPACE)
    if SPACE + SPACE in text:
        return _WORDS.findall(text)
    return [w for w in text.replace(SPACE, CUT + SPACE).replace("\n", CUT + "\n" + CUT).split(CUT) if w]


class _Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Lattice:
    """The lattices of many words: nodes are character positions, edges (by source) are pieces or byte runs.

    It grows by the words it does not know yet (``add``); ``words`` numbers them.
    """

    PARTS = ("start", "last", "src", "dst", "ids", "first", "degree", "logp", "p", "cum")

    def __init__(self, v: Vocabulary):
        self.v, self.words, self.runs, self.run_of = v, _Numbers(), [], {}  # runs of several bytes: edge id -1 - position
        for name in self.PARTS:
            kind = bool if name == "last" else float if name in ("logp", "p") else np.float32 if name == "cum" else np.int32
            setattr(self, name, np.empty(0, kind))

    def add(self, words: list[str]) -> None:
        base_node, base_edge = len(self.last), len(self.src)
        parts = self._build(words)
        for name, more in zip(self.PARTS, parts):
            old = getattr(self, name)
            shift = base_node if name in ("start", "src", "dst") else base_edge if name == "first" else 0
            setattr(self, name, np.concatenate((old, (more + shift if shift else more).astype(old.dtype))))

    def _build(self, words: list[str]) -> tuple[np.ndarray, ...]:
        v = self.v
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = np.cumsum(sizes)
        start = stop - sizes + np.arange(len(words))  # first node; a word has one node more than characters
        node = np.arange(len(codes)) + np.repeat(np.arange(len(words)), sizes)
        n = len(codes) + len(words)
        last = np.zeros(n, bool)
        last[start + sizes] = True
        left = np.repeat(stop, sizes) - np.arange(len(codes))
        degree = np.zeros(n, np.int64)
        found = []  # source, its how-manieth edge, length, id, weight
        rows, h, single = np.arange(len(codes)), None, np.zeros(len(codes), bool)
        for length in range(1, v.longest + 1):
            keep = left[rows] >= length
            rows, h = rows[keep], None if h is None else h[keep]
            if not len(rows):
                break
            h = _hash(codes[rows + length - 1], h)
            at, what = v.find(h, length)
            if length == 1:
                single[rows[at]] = True
                odd, ids, weight = np.flatnonzero(~single), [], []
                for c in codes[odd].tolist():
                    if c not in self.run_of:
                        run = v.byte_id[list((SPACE if chr(c) == OWN else chr(c)).encode())].tolist()
                        self.run_of[c] = run[0] if len(run) == 1 else -1 - len(self.runs), v.byte_weight * len(run)
                        if len(run) > 1:
                            self.runs.append(run)
                    ids.append(self.run_of[c][0]), weight.append(self.run_of[c][1])
                if len(odd):
                    found.append((node[odd], np.zeros(len(odd), np.int64), 1, np.array(ids, np.int64), np.array(weight)))
                    degree[node[odd]] = 1
            s = node[rows[at]]
            found.append((s, degree[s], length, what[:, 1], v.weight[what[:, 0]]))
            degree[s] += 1
        first = np.cumsum(degree) - degree
        m = int(degree.sum())
        src, dst, ids, weight = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m)
        for s, nth, length, i, w in found:
            e = first[s] + nth
            src[e], dst[e], ids[e], weight[e] = s, s + length, i, w
        # log-mass from each node to its word's end, nodes with the fewest characters left first
        togo = np.zeros(n, np.int64)
        togo[node] = left
        key = togo[src]
        beta, by = np.zeros(n), np.argsort(key.astype(np.int16) if not m or key.max() < 1 << 15 else key, kind="stable")
        s_by, d_by, w_by, key = src[by], dst[by], weight[by], key[by]
        groups = np.flatnonzero(np.diff(key, prepend=-1))
        for a, b in zip(groups, [*groups[1:], m]):
            heads = np.flatnonzero(np.diff(s_by[a:b], prepend=-1))
            beta[s_by[a:b][heads]] = np.logaddexp.reduceat(w_by[a:b] + beta[d_by[a:b]], heads)
        logp = weight + beta[dst] - beta[src]
        p = np.exp(logp)
        total = np.cumsum(p)
        cum = total - np.concatenate(([0.0], total))[first[src]]
        if m:
            cum[(first + degree - 1)[degree > 0]] = 2.0  # the last edge takes what rounding leaves
        return start, last, src, dst, ids, first, degree, logp, p, cum

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        e = self.first[node]
        rows = np.flatnonzero(u > self.cum[e])
        while len(rows):
            e[rows] += 1
            rows = rows[u[rows] > self.cum[e[rows]]]
        return e

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Completes words from the given nodes (``key``: the stream of each): edges of each, and all, word by word."""
        rows = np.flatnonzero(~self.last[node])
        now, key, c, steps, count = node[rows], key[rows], 0, [], np.zeros(len(node), np.int64)
        while len(rows):
            e = self.draw(now, uniform(key, c))
            steps.append((rows, e))
            c += 1
            now = self.dst[e]
            on = ~self.last[now]
            count[rows[~on]] = c
            rows, now, key = rows[on], now[on], key[on]
        offset, out = np.cumsum(count) - count, np.empty(int(count.sum()), np.int32)
        for c, (rows, e) in enumerate(steps):
            out[offset[rows] + c] = e
        return count, out


def _cut_gumbel(place: float, bound: float, u: float) -> float:
    """A Gumbel variable at ``place``, at most ``bound``."""
    return place - math.log(math.exp(min(place - bound, 700.0)) - math.log(u)) if place > -math.inf else -math.inf


class _Path:
    """A segmentation found, and the region beside it: what it left open from its ``since``-th edge on."""

    __slots__ = ("edges", "since", "gone", "value", "bound", "sums", "lead", "opened")

    def __init__(self, lat: Lattice, edges: np.ndarray, since: int, gone: list[int], value: float, u: float, sums: np.ndarray):
        self.edges, self.since, self.gone, self.value, self.sums, self.opened = edges, since, gone, value, sums, set()
        self.lead = float(sums[since - 1]) if since else 0.0
        self.bound = _cut_gumbel(self.mass(lat), value, u)

    def logp(self) -> float:
        return float(self.sums[-1]) if len(self.sums) else 0.0

    def first_mass(self, lat: Lattice) -> float:
        """Of leaving at the first open edge, over the mass of its prefix; ``gone`` are edges taken there before."""
        e = self.edges[self.since]
        if len(self.gone) + 1 == lat.degree[lat.src[e]]:
            return 0.0
        return max(0.0, 1.0 - float(lat.p[e]) - sum(float(lat.p[g]) for g in self.gone))

    def masses(self, lat: Lattice) -> np.ndarray:
        """Of leaving at each open edge, over the mass of the common prefix, without the places opened."""
        e = self.edges[self.since:]
        before = np.concatenate(([self.lead], self.sums[self.since:-1])) - self.lead
        out = np.exp(before) * np.where(lat.degree[lat.src[e]] > 1, np.maximum(1.0 - lat.p[e], 0.0), 0.0)
        out[0] = self.first_mass(lat)
        out[list(self.opened)] = 0.0
        return out

    def whole(self, lat: Lattice) -> float:
        """The region's mass over that of its prefix. Leaving at any later edge is what is left of one: no sum is needed."""
        after = float(self.sums[self.since]) - self.lead
        return self.first_mass(lat) - math.exp(after) * math.expm1(min(0.0, self.logp() - float(self.sums[self.since])))

    def mass(self, lat: Lattice) -> float:
        total = self.whole(lat) if self.since < len(self.edges) else 0.0
        return self.lead + math.log(total) if total > 0 else -math.inf

    def open(self, lat: Lattice, at: int) -> float:
        """Takes the segmentations that leave at an edge out of the region; the log-mass of the rest."""
        self.opened.add(at)
        total = self.whole(lat)
        if len(self.opened) == 1 and at:
            e = self.since + at
            rest = total - math.exp(float(self.sums[e - 1]) - self.lead) * (1.0 - float(lat.p[self.edges[e]]))
        else:
            rest = total - self.first_mass(lat) if len(self.opened) == 1 else 0.0
        if rest < 1e-3 * total:  # little is left, or several are out: add up what is left
            rest = float(self.masses(lat).sum())
        return self.lead + math.log(rest) if rest > 0 else -math.inf

    def leave(self, lat: Lattice, u: float) -> int:
        """Draws the open edge (counted from ``since``) where the region's best segmentation leaves."""
        if self.opened:
            total = np.cumsum(self.masses(lat))
            return int(min(np.searchsorted(total, u * total[-1], side="right"), np.flatnonzero(self.masses(lat))[-1]))
        first, x = self.first_mass(lat), u * self.whole(lat)
        after = math.exp(float(self.sums[self.since]) - self.lead)
        if x < first:
            return 0
        # behind edge t, 1 - exp(sum up to t) of the mass is spent: find the edge that spends x
        rest = self.sums[self.since + 1:]
        spent = float(self.sums[self.since]) + math.log1p(-min((x - first) / after, 1 - 1e-16))
        at = int(np.searchsorted(-rest, -spent, side="left"))
        at = min(at, len(rest) - 1)
        while at > 0 and lat.degree[lat.src[self.edges[self.since + 1 + at]]] < 2:  # rounding only: such an edge spends nothing
            at -= 1
        return at + 1


def sample(texts: list[str], keys: np.ndarray, lat: Lattice, k: int = SAMPLES) -> list[list[tuple]]:
    """Per text its samples (ids, log-probability, perturbed value, inclusion), best first."""
    n = len(texts)
    docs = [words_of(t) for t in texts]
    size, known = np.fromiter(map(len, docs), np.int64, n), len(lat.words)
    word = np.fromiter(map(lat.words.__getitem__, chain.from_iterable(docs)), np.int64, int(size.sum()))
    if len(lat.words) > known:
        lat.add(list(islice(lat.words, known, None)))
    word_from = np.cumsum(size) - size
    owner = np.repeat(np.arange(n), size)
    nth = np.arange(len(word)) - word_from[owner]

    def finish(rows: np.ndarray, node: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return lat.walk(node, keys[owner[rows]] + (nth[rows].astype(np.uint64) * np.uint64(64) + np.uint64(r + 1)) * _M2)

    def coins(r: int) -> list[list[float]]:
        return uniform((keys ^ np.uint64(0x5851F42D4C957F2D + r))[:, None], np.arange(5)[None, :]).tolist()

    every = np.arange(len(word))
    count, edges = finish(every, lat.start[word], 0)
    ends = np.cumsum(count)  # of the words, in edges
    per = np.bincount(owner, weights=count, minlength=n).astype(np.int64)
    stop = np.cumsum(per)
    # per text, so that the figures do not depend on the batch
    sums = np.concatenate([*(np.cumsum(lat.logp[edges[b - c: b]]) for b, c in zip(stop.tolist(), per.tolist())), np.empty(0)])
    paths: list[list[_Path]] = []
    for i, u in enumerate(coins(0)):
        a, b = stop[i] - per[i], stop[i]
        paths.append([_Path(lat, edges[a:b], 0, [], -math.log(-math.log(u[0])), u[1], sums[a:b])])
    for r in range(1, k):
        jobs = []
        for i, u in enumerate(coins(r)):
            best = max(paths[i], key=lambda q: q.bound)
            if best.bound == -math.inf or len(paths[i]) < r:
                continue
            value = best.bound
            at = best.leave(lat, u[0])
            gone = [*(best.gone if at == 0 else []), int(best.edges[best.since + at])]
            best.bound = _cut_gumbel(best.open(lat, at), value, u[1])
            node = int(lat.src[gone[-1]])
            lo, hi = int(lat.first[node]), int(lat.first[node] + lat.degree[node])
            left = lat.p[lo:hi].copy()
            left[np.array(gone) - lo] = 0.0
            total = np.cumsum(left)
            edge = lo + int(min(np.searchsorted(total, u[2] * total[-1], side="right"), np.flatnonzero(left)[-1]))
            # the word it is in: words before it in this segmentation are whole
            at += best.since
            lengths = lat.last[lat.dst[best.edges[:at]]].sum()
            jobs.append((i, best, at, gone, edge, value, u[3], int(word_from[i] + lengths)))
        if not jobs:
            break
        rest = np.array([word_from[j[0]] + size[j[0]] - j[7] for j in jobs])
        heads = np.cumsum(rest) - rest
        rows = np.repeat(np.array([j[7] for j in jobs]), rest) + np.arange(int(rest.sum())) - np.repeat(heads, rest)
        node = lat.start[word[rows]]
        node[heads] = lat.dst[[j[4] for j in jobs]]
        count, tail = finish(rows, node, r)
        marks = np.concatenate(([0], np.cumsum(count)))[np.concatenate((heads, [len(rows)]))]
        for j, (i, best, at, gone, edge, value, u, _) in enumerate(jobs):
            new = np.concatenate((best.edges[:at], [edge], tail[marks[j]: marks[j + 1]])).astype(np.int32)
            more = np.cumsum(lat.logp[new[at:]]) + (best.sums[at - 1] if at else 0.0)
            paths[i].append(_Path(lat, new, at, gone, value, u, np.concatenate((best.sums[:at], more))))
    out = []
    for found in paths:
        limit, rows = max(q.bound for q in found), []
        for q in found:
            ids = lat.ids[q.edges]
            if lat.runs and len(ids) and ids.min() < 0:
                ids = np.array([y for x in ids.tolist() for y in ([x] if x >= 0 else lat.runs[-1 - x])], np.int32)
            rows.append((ids, q.logp(), q.value, 1.0 if limit == -math.inf else -math.expm1(-math.exp(min(q.logp() - limit, 700.0)))))
        out.append(rows)
    return out


def model_bytes(path: str = MODEL) -> bytes:
    return Path(path).read_bytes()


_loaded: dict[int, Lattice] = {}


def _lattice(model: bytes) -> Lattice:
    """The worker's lattice: kept between batches, begun anew beyond ``EDGES``; results do not depend on it."""
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Lattice(Vocabulary(model))
    elif len(_loaded[key].src) > EDGES:
        _loaded[key] = Lattice(_loaded[key].v)
    return _loaded[key]


def encode_samples(docs: DataFrame, k: int = SAMPLES, seed: int = 0, model: str = MODEL) -> DataFrame:
    """Documents (doc_id, text) → a row per sample: doc_id, sample (1 …), ids, n_pieces, log_prob, perturbed, inclusion, decoded_equal."""
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    rows = docs.select("doc_id", text_of().alias("text"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, chars = batch.column("key").to_numpy().view(np.uint64), np.cumsum(pc.utf8_length(batch.column("text")).to_numpy())
            at = 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(chars, CHARS + (chars[at - 1] if at else 0), side="right")))
                texts = batch.column("text").slice(at, to - at).to_pylist()
                lat = _lattice(sent.value)
                v, got = lat.v, sample(texts, keys[at:to], lat, k)
                flat = [(i, j, *s) for i, d in enumerate(got) for j, s in enumerate(d)]
                ids = [x[2] for x in flat]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                values = np.concatenate(ids or [np.empty(0)]).astype(np.int32)
                back = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v.pieces.take(pa.array(values))), b"")
                want = pa.array([b" " + texts[x[0]].encode() if texts[x[0]] else b"" for x in flat], pa.binary())
                equal = pc.equal(back, want)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array([at + x[0] for x in flat])), pa.array([x[1] + 1 for x in flat], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
                    pa.array([len(x) for x in ids], pa.int64()), *[pa.array([x[c] for x in flat], pa.float64()) for c in (3, 4, 5)],
                    equal], names=["doc_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "decoded_equal"])
                at = to
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, sample int, ids array<int>, n_pieces long, log_prob double, perturbed double, inclusion double, decoded_equal boolean")


def decode_samples(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows with ``ids`` → + text, all other columns kept."""
    sent = encoded.sparkSession.sparkContext.broadcast(model_bytes(model))

    @F.pandas_udf("string")
    def decode(ids):
        v = _lattice(sent.value).v
        return ids.map(lambda x: None if x is None else v.decode(list(x)) if len(x) else "")
    return encoded.withColumn("text", decode("ids"))
