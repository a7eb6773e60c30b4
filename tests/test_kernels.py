"""The pairing kernels against brute force on small random inputs. No Spark needed."""

import random

import pytest

from palimpsest.functions import kernels as K


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def check_matches(a, b, got):
    assert all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert len(got) == lcs_length(a, b)


def test_common_subsequence_is_longest():
    rnd = random.Random(1)
    for _ in range(400):
        a = [rnd.randrange(5) for _ in range(rnd.randrange(30))]
        b = [rnd.randrange(5) for _ in range(rnd.randrange(30))]
        check_matches(a, b, K.common_subsequence(a, b))


def table_walk(a, b):
    """The plain table, walked back from its end: up while the length stays, then left, else a match."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    i, j, out = len(a), len(b), []
    while i and j:
        if n[i][j] == n[i - 1][j]:
            i -= 1
        elif n[i][j] == n[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


@pytest.mark.parametrize("bits", [1 << 31, 400, 20, 1])
def test_memory_does_not_change_the_alignment(monkeypatch, bits):
    monkeypatch.setattr(K, "MATRIX_BITS", bits)
    monkeypatch.setattr(K, "MARKS", 3)
    rnd = random.Random(2)
    for _ in range(1000):
        values = rnd.choice([2, 4, 9])
        a, b = ([rnd.randrange(values) for _ in range(rnd.randrange(60))] for _ in range(2))
        lo = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        end = next((i for i, (x, y) in enumerate(zip(a[lo:][::-1], b[lo:][::-1])) if x != y), min(len(a), len(b)) - lo)
        ma, mb = a[lo:len(a) - end], b[lo:len(b) - end]
        want = [(i, i) for i in range(lo)] + [(i + lo, j + lo) for i, j in table_walk(ma, mb)] + [(len(a) - end + k, len(b) - end + k) for k in range(end)]
        got = K.common_subsequence(a, b)
        check_matches(a, b, got)
        assert got == want


def test_large_sides_within_the_limit(monkeypatch):
    rnd = random.Random(5)
    a = [rnd.randrange(300) for _ in range(3000)]
    b = [x for x in a if rnd.random() < .8] + [rnd.randrange(300) for _ in range(500)]
    whole = K.common_subsequence(a, b)
    monkeypatch.setattr(K, "MATRIX_BITS", 100_000)
    assert K.common_subsequence(a, b) == whole


def test_stretches_cover_both_sides():
    rnd = random.Random(3)
    for _ in range(200):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(12))]
        b = [rnd.randrange(4) for _ in range(rnd.randrange(12))]
        i = j = 0
        for a0, an, b0, bn, eq in K.stretches(a, b):
            assert (a0, b0) == (i, j) and an + bn > 0
            assert not eq or a[a0:a0 + an] == b[b0:b0 + bn]
            i, j = i + an, j + bn
        assert (i, j) == (len(a), len(b))


def dice(x, y):
    from collections import Counter
    total = len(x) + len(y)
    return 1.0 if not total else 2 * (Counter(x) & Counter(y)).total() / total


def best_weight(a, b):
    """Largest total similarity of an order-preserving one-to-one pairing."""
    table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = dice(a[i - 1], b[j - 1])
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + s if s >= 0.3 else 0)
    return table[-1][-1]


def test_gap_pairing_has_the_best_weight():
    rnd = random.Random(4)
    for _ in range(200):
        a = [[rnd.randrange(6) for _ in range(rnd.randrange(6))] for _ in range(rnd.randrange(1, 6))]
        b = [[rnd.randrange(6) for _ in range(rnd.randrange(6))] for _ in range(rnd.randrange(1, 6))]
        got = K.pair_gap(a, b, False)
        assert [i for g in got if g[1] for i in [g[0]]] == list(range(len(a)))
        assert [j for g in got if g[3] for j in [g[2]]] == list(range(len(b)))
        weight = sum(dice(a[g[0]], b[g[2]]) for g in got if g[1] and g[3])
        assert abs(weight - best_weight(a, b)) < 1e-9


def test_split_and_merge():
    whole = list(range(20))
    assert K.pair_gap([whole], [whole[:11], whole[11:]], True) == [(0, 1, 0, 2)]
    assert K.pair_gap([whole[:11], whole[11:]], [whole], True) == [(0, 2, 0, 1)]
    assert (0, 1, 0, 2) not in K.pair_gap([whole], [whole[:11], whole[11:]], False)


def group_weight(x, y):
    """What a group of blocks weighs, or nothing if it is not one."""
    if len(x) == len(y) == 1:
        d = dice(x[0], y[0])
        return d if d >= 0.3 else None
    one, parts = (x[0], y) if len(x) == 1 else (y[0], x)
    share = lambda p: (dice(p, one) * (len(p) + len(one)) / 2) / max(len(p), 1)
    d = dice(one, sum(parts, []))
    return d * (1 + len(parts)) / 2 if d >= 0.8 and all(share(p) >= 0.8 - 1e-12 and p for p in parts) else None


def test_gap_pairing_with_spans_has_the_best_weight():
    rnd, several = random.Random(6), 0
    shapes = [(1, k) for k in range(1, 5)] + [(k, 1) for k in range(2, 5)]
    for _ in range(300):
        words = [rnd.randrange(12) for _ in range(rnd.randrange(4, 24))]
        cut = lambda: [list(p) for p in _pieces([w for w in words if rnd.random() > 0.05], rnd)]
        a, b = cut(), cut()
        best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = [0.0, best[i - 1][j] if i else 0.0, best[i][j - 1] if j else 0.0]
                for p, q in shapes:
                    w = group_weight(a[i - p:i], b[j - q:j]) if i >= p and j >= q else None
                    ways += [] if w is None else [best[i - p][j - q] + w]
                best[i][j] = max(ways)
        got = K.pair_gap(a, b, True)
        assert [i for g in got for i in range(g[0], g[0] + g[1])] == list(range(len(a)))
        assert [j for g in got for j in range(g[2], g[2] + g[3])] == list(range(len(b)))
        linked = [g for g in got if g[1] and g[3]]
        several += sum(g[1] + g[3] > 2 for g in linked)
        assert abs(sum(group_weight(a[g[0]:g[0] + g[1]], b[g[2]:g[2] + g[3]]) for g in linked) - best[-1][-1]) < 1e-9
    assert several > 50


def _pieces(words, rnd):
    at = 0
    while at < len(words):
        k = rnd.randrange(1, 9)
        yield words[at:at + k]
        at += k


def test_a_large_gap_is_paired_like_a_small_one():
    a = [[("a", i, k) for k in range(6)] + ["the", "of"] for i in range(220)]
    b = [row[:5] + [("b", i), "the", "of"] for i, row in enumerate(a)]
    del b[100]
    b.insert(30, ["new"] * 9)
    want = [(i, 1, i + (i >= 30) - (i > 100), 1) for i in range(220) if i != 100]
    assert [g for g in K.pair_gap(a, b, True) if g[1] and g[3]] == want
    assert sum(1 for g in K.pair_gap(a * 5, b * 5, True) if g[1] and g[3]) == 5 * 219


def test_pairing_by_position_is_a_mode():
    a = [[i, i + 1] for i in range(0, 500, 2)]
    b = [x if k % 2 else [-k, -k - 1] for k, x in enumerate(a, start=1)]
    got = K.pair_positions(a, b)
    assert sum(1 for g in got if g[1] and g[3]) == 125 and len(got) == 375


def test_short_equal_island_is_absorbed():
    info = lambda words: [len(w) * 4 + (w == " ") for w in words]
    a, b = ["ab", "x", "cd"], ["ef", "x", "gh"]
    assert K.edit_runs(a, b, info(a), info(b)) == [[False, [0, 1, 2], [0, 1, 2]]]
    a, b = ["ab", " ", "cd"], ["ef", " ", "gh"]
    assert [r[0] for r in K.edit_runs(a, b, info(a), info(b))] == [False, True, False]


def test_overlaps_do_not_depend_on_how_many_are_worked_out_at_a_time(monkeypatch):
    from collections import Counter
    rng = random.Random(11)
    for _ in range(60):
        a, b = ([[rng.randrange(6) for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 8))] for _ in "ab")
        want = [[(Counter(x) & Counter(y)).total() for y in b] for x in a]
        groups = {(split, cells): None for split in (True, False) for cells in (1, 9, 1 << 20)}
        for split, cells in groups:
            monkeypatch.setattr(K, "CELLS", cells)
            assert [r.tolist() for r in K.overlaps(a, b)] == want
            groups[split, cells] = K.pair_gap(a, b, split)
        assert all(groups[split, 1] == groups[split, c] for split in (True, False) for c in (9, 1 << 20))


def test_rows_of_a_slice_with_nulls():
    import pyarrow as pa
    x = pa.array([[[1], []], None, [[2, 3]], [], [[4], [5, 6]]])
    assert [K._rows(x.slice(i, 3)) for i in range(3)] == [x.slice(i, 3).to_pylist() for i in range(3)]
