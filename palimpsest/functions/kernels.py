"""Arrow functions for the order-preserving pairing that built-in operators cannot express.

Spark partitions the work: one row is one section of one pair, one gap or one changed row.
Only 64-bit keys travel; the texts stay in the JVM.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.options import PAIR_MIN_DICE, SPLIT_MAX_PARTS, SPLIT_MIN

# Rows of the table held at a time, in bits (256 MB); beyond that, rows are kept at marks and the stretches between
# two marks worked out again. The alignment does not depend on it.
MATRIX_BITS, MARKS = 1 << 31, 32


def _places(a: list) -> dict:
    """The places of every value of a, as bits."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    return where


def _table_rows(where: dict, b: list, v: int, full: int) -> Iterator[int]:
    """Rows of the table after each entry of b, from the row v before it. Bit i of a row is 0 where a[i] adds one to
    the common length with b up to there; a bit depends on lower ones only, so ``full`` may cut rows short."""
    for y in b:
        m = where.get(y, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
        yield v


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence, in order."""
    lo, ha, hb = 0, len(a), len(b)
    while lo < ha and lo < hb and a[lo] == b[lo]:
        lo += 1
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    head = [(i, i) for i in range(lo)]
    tail = [(ha + k, hb + k) for k in range(len(a) - ha)]
    ma, mb = a[lo:ha], b[lo:hb]
    mid = _traced(ma, mb, MATRIX_BITS) if ma and mb else []
    return head + [(i + lo, j + lo) for i, j in mid] + tail


def _traced(a: list, b: list, bits: int) -> list[tuple[int, int]]:
    """One walk back through the table, whichever part of it is held."""
    where, out = _places(a), []

    def back(lo: int, hi: int, v: int, i: int) -> int:
        """Walks from (i, hi) to column lo, whose row is v; returns the place in a reached there."""
        full = (1 << i) - 1
        v &= full
        if (hi - lo) * i > bits and hi - lo > 1:
            step = -(-(hi - lo) // MARKS)
            marks = [(lo, v)]
            for at in range(lo + step, hi, step):
                for v in _table_rows(where, b[at - step:at], v, full):
                    pass
                marks.append((at, v))
            for at, v in reversed(marks):
                i = back(at, min(at + step, hi), v, i)
            return i
        rows, j = [v, *_table_rows(where, b[lo:hi], v, full)], hi
        while i and j > lo:
            if rows[j - lo] >> (i - 1) & 1:
                i -= 1
            elif not rows[j - 1 - lo] >> (i - 1) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return i

    back(0, len(b), (1 << len(a)) - 1, len(a))
    out.reverse()
    return out


# ---- token scripts ----------------------------------------------------------
# A token's info is 4·length + 1 for white space, + 2 for a cell break.

def edit_runs(a: list, b: list, ia: list, ib: list) -> list[list]:
    """Alternating runs [is_equal, a indexes, b indexes] of the alignment of two token rows."""
    runs: list[list] = []
    pa_, pb_ = 0, 0
    for i, j in common_subsequence(a, b) + [(len(a), len(b))]:
        if i > pa_ or j > pb_:
            runs.append([False, list(range(pa_, i)), list(range(pb_, j))])
        if i < len(a):
            if runs and runs[-1][0]:
                runs[-1][1].append(i)
                runs[-1][2].append(j)
            else:
                runs.append([True, [i], [j]])
        pa_, pb_ = i + 1, j + 1
    return absorb_islands(runs, ia, ib)


def absorb_islands(runs: list[list], ia: list, ib: list) -> list[list]:
    """An equal run of 1–2 characters between two differing runs joins them, if it holds neither
    white space nor a cell break and is no longer than the longer neighbour. Repeated until nothing changes."""
    size = lambda r: sum(ia[i] >> 2 for i in r[1]) + sum(ib[j] >> 2 for j in r[2])
    while True:
        changed, out, k = False, [], 0
        while k < len(runs):
            r = runs[k]
            inner = r[0] and out and k + 1 < len(runs)
            if inner and not any(ia[i] & 3 for i in r[1]):
                n = sum(ia[i] >> 2 for i in r[1])
                if 0 < n <= 2 and n <= max(size(out[-1]), size(runs[k + 1])):
                    left, right = out.pop(), runs[k + 1]
                    out.append([False, left[1] + r[1] + right[1], left[2] + r[2] + right[2]])
                    changed, k = True, k + 2
                    continue
            out.append(r)
            k += 1
        runs = out
        if not changed:
            return runs


# ---- gaps -------------------------------------------------------------------

# Weights are whole numbers of this unit, so that sums and ties are exact.
UNIT = 1 << 40


# Entries of the table of overlaps, and words met, that are worked out at a time; the overlaps do not depend on it.
CELLS = 1 << 20


def _words(rows: list[list], number: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and how-manieth occurrence in its row of all tokens: shared entries count the multiset intersection."""
    word = np.array([number.setdefault(x, len(number)) for x in chain.from_iterable(rows)], dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.lexsort((word, row))
    word, row, at = word[order], row[order], np.arange(len(word))
    fresh = np.ones(len(word), dtype=bool)
    fresh[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    return row, word, at - np.maximum.accumulate(np.where(fresh, at, 0))


def overlaps(rows: list[list], others: list[list]) -> Iterator[np.ndarray]:
    """Per row: its multiset intersection with every other row, from an inverted index, a stretch of rows at a time."""
    number: dict = {}
    row, word, nth = _words(rows, number)
    other, theirs, their_nth = _words(others, number)
    deep = 1 + max(nth.max(initial=0), their_nth.max(initial=0))
    mine, keys, m = word * deep + nth, theirs * deep + their_nth, len(others)
    order = np.argsort(keys, kind="stable")
    keys, other = keys[order], other[order]
    left = np.searchsorted(keys, mine, "left")
    hits = np.searchsorted(keys, mine, "right") - left
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    met = np.concatenate(([0], np.cumsum(hits)))[ends]
    at = 0
    while at < len(rows):
        to = max(at + 1, min(at + CELLS // max(m, 1), int(np.searchsorted(met, met[at] + CELLS, "right")) - 1, len(rows)))
        part = slice(ends[at], ends[to])
        n = hits[part]
        place = np.repeat(left[part] - (np.cumsum(n) - n), n) + np.arange(met[to] - met[at])
        cell = np.repeat(row[part] - at, n) * m + other[place]
        yield from np.bincount(cell, minlength=(to - at) * m).reshape(to - at, m)
        at = to


def spans(ones: list[list], parts: list[list], shared: Iterable[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per single block: the runs (first, number, weight) of consecutive parts that it is made of; ``shared`` are its
    overlaps with the parts."""
    sizes = np.array([len(r) for r in parts], dtype=np.int64)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    found = []
    for one, common in zip(ones, shared):
        inside = common / np.maximum(sizes, 1) >= SPLIT_MIN
        if not (inside[1:] & inside[:-1]).any():
            found.append([])
            continue
        whole, here = Counter(one), []
        for k in range(2, min(SPLIT_MAX_PARTS, len(parts)) + 1):
            length = upto[k:] - upto[:-k]
            fits = 2 * np.minimum(length, len(one)) >= SPLIT_MIN * (length + len(one))
            for j in np.flatnonzero(np.lib.stride_tricks.sliding_window_view(inside, k).all(axis=1) & fits).tolist():
                both = (whole & Counter(chain.from_iterable(parts[j:j + k]))).total()
                share = 2 * both / (len(one) + int(length[j]))
                if share >= SPLIT_MIN:
                    here.append((j, k, round(share * (1 + k) / 2 * UNIT)))
        found.append(here)
    return found


def pair_gap(a: list[list], b: list[list], split: bool) -> list[tuple[int, int, int, int]]:
    """Groups (first a, number of a, first b, number of b) that cover a gap in reading order.

    The chain of pairs and spans with the largest total weight, exact at any size. Of equally heavy chains, that
    whose last group ends first in a, then in b, is taken, and a pair before a span. A row of the table is one
    array step; kept are the last few rows and the groups that made some chain heavier.
    """
    m = len(b)
    nb = np.array([len(r) for r in b], dtype=np.int64)
    known = np.array(list(overlaps(a, b))) if 0 < len(a) * m <= CELLS else None
    ahead = lambda: overlaps(a, b) if known is None else known
    cuts = spans(a, b, ahead()) if split else [[]] * len(a)
    merges: dict[int, list] = {}
    for j, runs in enumerate(spans(b, a, overlaps(b, a) if known is None else known.T) if split else []):
        for i, k, w in runs:
            merges.setdefault(i + k, []).append((j, k, w))
    best, tip = np.zeros(m + 1, dtype=np.int64), np.full(m + 1, -1, dtype=np.int64)
    recent, groups, made = [(best, tip)], [np.empty((0, 5), dtype=np.int64)], 0
    for end, (row, common) in enumerate(zip(a, ahead()), start=1):
        total = nb + len(row)
        dice = np.where(total == 0, 1.0, 2.0 * common / np.maximum(total, 1))
        value = np.full(m + 1, -1, dtype=np.int64)
        value[1:] = np.where(dice >= PAIR_MIN_DICE, best[:-1] + np.rint(dice * UNIT).astype(np.int64), -1)
        wide, tall = np.ones(m + 1, dtype=np.int64), np.ones(m + 1, dtype=np.int64)
        before = np.concatenate(([-1], tip[:-1]))
        longer = [(1, k, j, w) for j, k, w in cuts[end - 1]] + [(k, 1, j, w) for j, k, w in merges.get(end, [])]
        for p, q, j, w in longer:
            weight, last = recent[-p]
            if weight[j] + w > value[j + q]:
                value[j + q], tall[j + q], wide[j + q], before[j + q] = weight[j] + w, p, q, last[j]
        most = np.maximum(value, best)
        run = np.maximum.accumulate(most)
        fresh = most > np.concatenate(([-1], run[:-1]))
        at = np.flatnonzero(fresh & (value > best))
        own = tip.copy()
        own[at] = made + np.arange(len(at))
        groups.append(np.stack((end - tall[at], tall[at], at - wide[at], wide[at], before[at]), axis=1))
        made += len(at)
        source = np.maximum.accumulate(np.where(fresh, np.arange(m + 1), 0))
        best, tip = run, np.where(best == run, tip, own[source])
        recent = [*recent[1 - SPLIT_MAX_PARTS:], (best, tip)]
    table, k, linked = np.concatenate(groups), int(tip[-1]), []
    while k >= 0:
        *group, k = table[k].tolist()
        linked.append(tuple(group))
    return _covering(linked[::-1], len(a), m)


def _covering(linked: list[tuple], n: int, m: int) -> list[tuple[int, int, int, int]]:
    """The groups with all single blocks between them, those of side a first."""
    out, i, j = [], 0, 0
    for group in [*linked, (n, 0, m, 0)]:
        out += [(x, 1, j, 0) for x in range(i, group[0])]
        out += [(group[0], 0, y, 1) for y in range(j, group[2])]
        i, j = group[0] + group[1], group[2] + group[3]
        out.append(group)
    return out[:-1]


def pair_positions(a: list[list], b: list[list]) -> list[tuple[int, int, int, int]]:
    """The mode a caller may ask for: block k goes with block k if they are similar enough."""
    def alike(x: list, y: list) -> bool:
        return not x and not y or 2 * (Counter(x) & Counter(y)).total() >= PAIR_MIN_DICE * (len(x) + len(y))
    out: list[tuple] = []
    for k, (x, y) in enumerate(zip_longest(a, b)):
        if x is not None and y is not None and alike(x, y):
            out.append((k, 1, k, 1))
        else:
            out += [(k, 1, k, 0)] * (x is not None) + [(k, 0, k, 1)] * (y is not None)
    return out


# ---- Arrow entry points -----------------------------------------------------

def _rows(col: pa.Array) -> list:
    """``to_pylist`` of lists of numbers, by way of their offsets."""
    if not pa.types.is_list(col.type):
        return col.to_pylist() if col.null_count else col.to_numpy(zero_copy_only=False).tolist()
    inner, ends = _rows(col.values), col.offsets.to_numpy().tolist()
    out = [inner[i:j] for i, j in zip(ends, ends[1:])]
    return [x if ok else None for x, ok in zip(out, col.is_valid().to_pylist())] if col.null_count else out


def _structs(fields: list[tuple[str, list]], sizes: list[int], types: list) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    arrays = [pa.array(v, type=t) for (_, v), t in zip(fields, types)]
    inner = pa.StructArray.from_arrays(arrays, names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(offsets), inner)


def stretches(a: list, b: list) -> list[tuple[int, int, int, int, bool]]:
    """Maximal stretches (first a, count, first b, count, equal?) of the alignment of two rows."""
    out: list[tuple] = []
    i0 = j0 = 0
    run = None
    for i, j in common_subsequence(a, b) + [(len(a), len(b))]:
        if run and (i > i0 or j > j0 or i == len(a) and j == len(b)):
            out.append((run[0], i0 - run[0], run[1], j0 - run[1], True))
            run = None
        if i > i0 or j > j0:
            out.append((i0, i - i0, j0, j - j0, False))
        if run is None:
            run = (i, j)
        i0, j0 = i + 1, j + 1
    return out


def _stretch_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    cols: list[list] = [[], [], [], [], []]
    sizes = []
    for ra, rb in zip(_rows(a), _rows(b)):
        got = [] if ra is None or rb is None else stretches(ra, rb)
        for col, vals in zip(cols, zip(*got)):
            col += vals
        sizes.append(len(got))
    return _structs(list(zip(("a0", "an", "b0", "bn", "eq"), cols)), sizes,
                    [pa.int32()] * 4 + [pa.bool_()])


def _script_batch(a: pa.Array, b: pa.Array, ia: pa.Array, ib: pa.Array) -> pa.Array:
    op, xs, ys, sizes = [], [], [], []
    for ra, rb, la, lb in zip(_rows(a), _rows(b), _rows(ia), _rows(ib)):
        n = len(op)
        if ra is None or rb is None:
            sizes.append(0)
            continue
        for equal, da, db in edit_runs(ra, rb, la, lb):
            if equal:
                op += [0] * len(da)
                xs += da
                ys += db
            else:
                op += [-1] * len(da) + [1] * len(db)
                xs += da + [None] * len(db)
                ys += [None] * len(da) + db
        sizes.append(len(op) - n)
    return _structs([("op", op), ("a", xs), ("b", ys)], sizes, [pa.int32()] * 3)


def _gap_rows(a: pa.Array, b: pa.Array, pair: Callable) -> pa.Array:
    cols: list[list] = [[], [], [], []]
    sizes = []
    for ra, rb in zip(_rows(a), _rows(b)):
        got = [] if ra is None or rb is None else pair(ra, rb)
        for col, vals in zip(cols, zip(*got)):
            col += vals
        sizes.append(len(got))
    return _structs(list(zip(("a0", "an", "b0", "bn"), cols)), sizes, [pa.int32()] * 4)


def _gap_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    return _gap_rows(a, b, lambda x, y: pair_gap(x, y, False))


def _gap_split_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    return _gap_rows(a, b, lambda x, y: pair_gap(x, y, True))


def _gap_position_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    return _gap_rows(a, b, pair_positions)


# Marked nondeterministic so that the optimizer neither repeats nor moves a call.
# The functions travel by value: executors need numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STRETCHES = "array<struct<a0:int,an:int,b0:int,bn:int,eq:boolean>>"
_SCRIPT = "array<struct<op:int,a:int,b:int>>"
_GROUPS = "array<struct<a0:int,an:int,b0:int,bn:int>>"


def key_stretches(a, b) -> Column:
    """Equal and differing stretches of two key arrays; null arrays are passed over."""
    return F.arrow_udf(_stretch_batch, _STRETCHES).asNondeterministic()(a, b)


def token_script(a, b, ia, ib) -> Column:
    """Edit script of two token-key arrays with their token infos."""
    return F.arrow_udf(_script_batch, _SCRIPT).asNondeterministic()(a, b, ia, ib)


def gap_groups(a, b) -> Column:
    """Pairing of the blocks of a gap, given as arrays of word-key arrays."""
    return F.arrow_udf(_gap_batch, _GROUPS).asNondeterministic()(a, b)


def gap_groups_split(a, b) -> Column:
    """The same with one block against two to four consecutive ones."""
    return F.arrow_udf(_gap_split_batch, _GROUPS).asNondeterministic()(a, b)


def gap_groups_by_position(a, b) -> Column:
    """Blocks paired by their place in the gap."""
    return F.arrow_udf(_gap_position_batch, _GROUPS).asNondeterministic()(a, b)
