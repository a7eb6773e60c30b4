"""Near-duplicate embeddings by a robust-pruned graph over balls of near-equal vectors.

1. Fold. Equal vectors become one. Vectors within a quarter of the link angle of a leader join its ball, twice in a
   row, so any two vectors of a ball are linked by the triangle inequality of angles: a dense group costs its size.
2. Shards. Leaders go to the cells of their nearest pivots (overlapping); a cell above ``CELL`` is clustered deeper
   with pivots of its own, so a leader has at most ``nearest`` x 2 ** levels rows, however dense its surroundings.
3. Graph. In each shard every leader gets a robust-pruned list from its nearest candidates and a hashed sample of far
   ones, with reverse edges. The lists that the shards give a leader are united; united edges within the widened range
   bring leaders of other cells into a shard.
4. Search. From the medoid of each connected part, and from its own place, every leader runs a greedy search that
   expands the best vector of its beam and all vectors of the widened range.
5. Verify. Single vectors are decided by their cosine in double precision, pairs of balls by their radii or, where
   those do not decide, by comparing their members block by block. Only what is verified is counted, once per pair.

A link can be missed (never invented): ``audit`` measures recall by brute force for ids divisible by 20. Vectors that
are all linked but no two near enough to fold, more than ``CELL`` of them, lose links that no shard has in common.

Defined cases: null vectors, zero vectors, vectors with null or non-finite parts, null labels and vectors without a
partner have no links and are components of their own; vectors of other lengths never link; equal vectors are
folded first and link with each other; repeated vec_ids count as separate vectors; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import components, saved

COSINE, NEAREST, CELL, PIVOTS, APART = 0.98, 3, 512, 16384, 0.9
FOLD, FANOUT, DEEPER, LEVELS = 2048, 16, 2, 12  # rows of a folding task; pivots, cells and levels of deeper clustering
DEGREE, CANDIDATES, FAR, ALPHA, BEAM, VISITS = 12, 64, 16, 1.2, 16, 32768
WIDER = 0.15  # radians by which the searched range exceeds the linked one
GROUP = ["label", "dim", "cell"]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, v) of vectors that can link."""
    return vectors.select("vec_id", "label", _given(vectors).alias("v")).where(_good(F.col("v")))


def _given(vectors: DataFrame) -> Column:
    """The components: single precision is kept as it is while rows move (tasks compute in doubles), all else is double."""
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    return F.col("embedding").cast(f"array<{'float' if single else 'double'}>")


def _good(v: Column) -> Column:
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0.0), F.lit(False))


def unit(rows) -> np.ndarray:
    x = np.array(list(rows), float)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angle(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _pivots(distinct: DataFrame, total: int) -> list[tuple[int, int, np.ndarray]]:
    """A bounded sample of vectors, no two of a label closer than ``APART``: at most ``PIVOTS`` rows on the driver."""
    want = min(PIVOTS, max(16, total // (CELL // 4)))
    got = distinct.withColumn("mark", F.xxhash64("rid", F.lit("pivot"))).orderBy("mark", "rid").limit(want).select("label", "dim", "v").toPandas()
    keep = []
    for (label, dim), part in got.groupby(["label", "dim"]):
        x, chosen = unit(part["v"]), []
        for i in range(len(x)):
            if not chosen or (x[chosen] @ x[i]).max() < APART:
                chosen.append(i)
        keep.append((int(label), int(dim), x[chosen]))
    return keep


def _nearest(x: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the ``k`` nearest pivots of each vector, nearest first."""
    out = [np.argsort(-(x[s:s + 1024] @ p.T), axis=1, kind="stable")[:, :k] for s in range(0, len(x), 1024)]
    return np.concatenate(out) if out else np.empty((0, k), int)


def _assign(pivots, nearest: int):
    """Vectors → + cells: the numbers of their nearest pivots (-1, one cell, where the sample has none)."""
    at = {(label, dim): p for label, dim, p in pivots}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = np.empty(len(b), object)
            for (label, dim), part in b.groupby(["label", "dim"]).indices.items():
                p = at.get((int(label), int(dim)))
                near = np.full((len(part), 1), -1) if p is None else _nearest(unit(b["v"].iloc[part]), p, nearest)
                for i, c in zip(part, near):
                    cells[i] = [str(k) for k in c]
            yield b.assign(cells=cells)
    return assign


def _lead(limit: float):
    """A part of a cell → (rid, lead, gap): its leaders, and an upper bound of the angle to them."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rid")
        x, ids = unit(part["v"]), part["rid"].to_numpy()
        sim = x @ x.T
        lead, gap, left = np.arange(len(x)), np.zeros(len(x)), np.ones(len(x), bool)
        for i in np.flatnonzero((sim >= np.cos(limit)).sum(1) > 1):
            if left[i]:
                mine = np.flatnonzero(left & (sim[i] >= np.cos(limit)))
                left[mine], lead[mine], gap[mine] = False, i, angle(sim[i, mine]) + 1e-7
                gap[i] = 0.0
        return pd.DataFrame({"rid": ids, "lead": ids[lead], "gap": gap})
    return run


def fold(assigned: DataFrame, least: float = COSINE) -> DataFrame:
    """Distinct vectors (label, dim, rid, v, cells) → (rid, lead, gap): balls whose vectors all link with each other."""
    limit = float(angle(least)) / 4 - 1e-5
    rows = assigned.select("label", "dim", F.col("cells")[0].alias("cell"), "rid", "v")

    def step(rows: DataFrame, parts: DataFrame, no: int) -> DataFrame:
        cut = F.pmod(F.xxhash64("rid", F.lit(no)), F.col("parts")).alias("cut")
        return saved(rows.join(parts, GROUP).select(*GROUP, cut, "rid", "v").groupBy(*GROUP, "cut").applyInPandas(
            _lead(limit), "rid long, lead long, gap double"))

    def parts_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*GROUP).agg(F.ceil(F.count("*") / FOLD).alias("parts"))
    parts = saved(parts_of(rows))
    once = step(rows, parts, 0)
    # a second time in cells that were cut: their leaders met in one part only
    leaders = once.where("rid = lead").select("rid")
    again = rows.join(parts.where("parts > 1"), GROUP, "left_semi").join(leaders, "rid", "left_semi")
    twice = step(again, parts_of(again), 1).select(F.col("rid").alias("lead"), F.col("lead").alias("to"), F.col("gap").alias("more"))
    return once.join(twice, "lead", "left").select("rid", F.coalesce("to", "lead").alias("lead"), (F.col("gap") + F.coalesce("more", F.lit(0.0))).alias("gap"))


def _split(both: pd.DataFrame) -> pd.DataFrame:
    """A bounded part of a large cell, with the cell's own pivots → its rows in the cells below."""
    part, pivots = (both[both["pivot"] == x].drop(columns=["cut", "pivot"]) for x in (False, True))
    if part.empty:
        return part.drop(columns="v")
    near = _nearest(unit(part["v"]), unit(pivots.sort_values("rid")["v"]), DEEPER)
    rows = part.loc[part.index.repeat(near.shape[1])]
    return rows.drop(columns="v").assign(cell=[f"{c}/{k}" for c, k in zip(rows["cell"], near.ravel())])


def shards_of(leaders: DataFrame, cell: int = CELL) -> DataFrame:
    """Leaders (label, dim, rid, v, cells) → (label, dim, cell, rid), one row per leader and shard.

    Cells above the bound are clustered deeper until none is left; what ``LEVELS`` levels cannot part is cut by hash.
    """
    placed = saved(leaders.select("label", "dim", F.explode("cells").alias("cell"), "rid"))
    done = None
    for level in range(LEVELS + 1):
        sizes = saved(placed.groupBy(*GROUP).agg(F.count("*").alias("size")))
        big = sizes.where(F.col("size") > cell)
        small = placed.join(big, GROUP, "left_anti")
        done = small if done is None else done.union(small)
        if big.isEmpty():
            return done
        rows = placed.join(big, GROUP)
        if level == LEVELS:
            piece = F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / cell))
            return done.union(rows.select("label", "dim", F.concat_ws("#", "cell", piece).alias("cell"), "rid"))
        cuts = F.ceil(F.col("size") / FOLD)
        rows = rows.join(leaders.select("rid", "v"), "rid")
        nth = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.xxhash64("rid", F.lit(level)), "rid"))
        pivots = (rows.withColumn("nth", nth).where(F.col("nth") <= FANOUT)
                  .select(*GROUP, F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)).alias("cut"), "rid", "v", F.lit(True).alias("pivot")))
        left = rows.select(*GROUP, F.pmod(F.xxhash64("rid", F.lit("cut")), cuts).alias("cut"), "rid", "v", F.lit(False).alias("pivot"))
        placed = saved(left.union(pivots).groupBy(*GROUP, "cut").applyInPandas(_split, placed.schema))


def prune(sim: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, far: int = FAR, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust pruning: keep the nearest candidate, drop those that it covers (``alpha`` times nearer to it than to us).

    Candidates are the nearest ones and a hashed sample of all. Edges are kept in both directions.
    """
    n = len(sim)
    k = min(candidates, n - 1)
    if k < 1:
        return [np.empty(0, int)] * n
    gap = np.sqrt(np.maximum(2 - 2 * sim, 0))
    order = np.argpartition(gap + np.eye(n) * 9, k - 1, axis=1)[:, :k]
    out = [set() for _ in range(n)]
    for i in range(n):
        sampled = (i + 1 + (np.arange(far) * 2654435761 + i * 40503) % (n - 1)) % n
        rest = np.union1d(order[i], sampled)
        rest = rest[np.argsort(gap[i, rest], kind="stable")]
        chosen = 0
        while len(rest) and chosen < degree:
            best, rest = int(rest[0]), rest[1:]
            chosen += 1
            out[i].add(best)
            out[best].add(i)
            rest = rest[alpha * gap[best, rest] > gap[i, rest]]
    return [np.array(sorted(x), int) for x in out]


def _build(reach: float):
    """One shard → the neighbour list of each leader, and which of its neighbours lie within the widened range."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rid")
        x, ids = unit(part["v"]), part["rid"].to_numpy()
        sim = x @ x.T
        near = prune(sim)
        return pd.DataFrame({"rid": ids, "near": [ids[c].tolist() for c in near],
                             "wide": [ids[c[sim[i, c] >= np.cos(reach)]].tolist() for i, c in enumerate(near)]})
    return run


def medoids(x: np.ndarray, lists: list[np.ndarray]) -> list[int]:
    """The medoid of each connected part of a graph."""
    up = list(range(len(x)))

    def top(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i
    for i, c in enumerate(lists):
        for j in c.tolist():
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    root = np.array([top(i) for i in range(len(x))], int)
    return [int(p[np.argmax(x[p] @ x[p].sum(0))]) for p in (np.flatnonzero(root == r) for r in np.unique(root))]


def search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, within: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The boolean matrix (queries by vectors) of what a range-expanding greedy search visits.

    ``within`` is each query's widened range in radians. All queries step at once: each expands the best vector of its
    beam and every vector in its range that it has not expanded yet. Cosines are computed for what is visited.
    """
    n, m = len(x), len(queries)
    degree = np.array([len(c) for c in lists])
    flat, first = np.concatenate([*lists, np.empty(0, int)]).astype(int), np.cumsum(degree) - degree
    score, done = np.full((m, n), -2.0), np.zeros((m, n), bool)  # -2: not visited
    starts = medoids(x, lists)
    score[:, starts] = x[queries] @ x[starts].T
    score[np.arange(m), queries] = 1.0
    least, active = np.cos(np.minimum(within, np.pi)), np.arange(m)
    while len(active):
        seen = score[active]
        waiting = np.where(done[active], -2.0, seen)
        best = waiting.argmax(1)
        k = min(beam, n) - 1
        edge = -np.partition(-seen, k, axis=1)[:, k]
        step = waiting >= least[active][:, None]
        top = waiting[np.arange(len(active)), best]
        go = np.flatnonzero((top > -2.0) & (top >= edge))
        step[go, best[go]] = True
        q, at = np.nonzero(step)
        done[active[q], at] = True
        # in bounded pieces: a piece visits about ``VISITS`` neighbours
        ends = np.cumsum(degree[at])
        cuts = np.searchsorted(ends, np.arange(VISITS, ends[-1] if len(ends) else 0, VISITS))
        for now, here in zip(np.split(active[q], cuts), np.split(at, cuts)):
            d = degree[here]
            to = flat[np.repeat(first[here] - (np.cumsum(d) - d), d) + np.arange(d.sum())]
            new = np.unique(np.repeat(now, d) * n + to)
            new = new[score.ravel()[new] == -2.0]
            for s in range(0, len(new), VISITS):
                a, b = np.divmod(new[s:s + VISITS], n)
                score[a, b] = np.einsum("ij,ij->i", x[queries[a]], x[b])
        active = active[step.any(1)]
    return score > -2.0


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, on the given components: every shard that two vectors share decides alike."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _search_shard(least: float):
    """One shard with its united lists → (a, b, whole): pairs of balls that link as a whole, or may link in part."""
    theta = float(angle(least))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rid").reset_index(drop=True)
        x, ids, radius = unit(part["v"]), part["rid"].to_numpy(), part["radius"].to_numpy()
        at = {v: i for i, v in enumerate(ids.tolist())}
        lists = [np.array([at[v] for v in c if v in at], int) for c in part["near"]]
        queries = np.flatnonzero(part["member"].to_numpy())
        i, j = np.nonzero(search(x, lists, queries, theta + radius[queries] + radius.max() + WIDER))
        i = queries[i]
        i, j = i[i != j], j[i != j]
        i, j = np.divmod(np.unique(np.minimum(i, j) * len(x) + np.maximum(i, j)), len(x))
        v, out = np.array(part["v"].tolist(), float), []
        for s in range(0, len(i), 16384):
            a, b = i[s:s + 16384], j[s:s + 16384]
            cos, spread = cosines(v[a], v[b]), radius[a] + radius[b]
            apart = angle(cos)
            whole = np.where(spread == 0, cos >= least, apart + spread < theta - 1e-6)
            maybe = whole | ((spread > 0) & (apart - spread <= theta + 1e-6))
            out.append(pd.DataFrame({"a": ids[a][maybe], "b": ids[b][maybe], "whole": whole[maybe]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "whole": []}).astype({"a": "int64", "b": "int64", "whole": bool})
    return run


def _compare(least: float):
    """A block of the members of each of two balls → (rid, links): rows linked with on the other side."""
    def run(both: pd.DataFrame) -> pd.DataFrame:
        one, two = both[both["first"]], both[~both["first"]]
        if one.empty or two.empty:
            return pd.DataFrame({"a": [], "b": [], "rid": [], "links": []}).astype("int64")
        sim = unit(one["v"]) @ unit(two["v"]).T
        hit = sim >= least + 1e-9
        i, j = np.nonzero((sim >= least - 1e-9) & ~hit)
        if len(i):
            v, w = np.array(one["v"].tolist(), float), np.array(two["v"].tolist(), float)
            hit[i, j] = cosines(v[i], w[j]) >= least
        links = np.concatenate((hit @ two["n"].to_numpy(), hit.T @ one["n"].to_numpy()))
        out = pd.DataFrame({"a": one["a"].iloc[0], "b": one["b"].iloc[0], "rid": np.concatenate((one["rid"], two["rid"])), "links": links})
        return out[links > 0]
    return run


def ball_pairs(balls: DataFrame, least: float = COSINE) -> DataFrame:
    """Balls (label, dim, rid, v, cells, radius) → (a, b, whole), each pair once, a < b."""
    placed = saved(shards_of(balls))
    reach = float(angle(least)) * 2 + WIDER
    built = saved(placed.join(balls.select("rid", "v"), "rid").groupBy(*GROUP).applyInPandas(_build(reach), "rid long, near array<long>, wide array<long>"))
    united = saved(built.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
                                            F.array_distinct(F.flatten(F.collect_list("wide"))).alias("wide")))
    facts = balls.select("rid", "radius", "v")
    homes = placed.select(*GROUP, "rid")
    members = homes.join(united, "rid")
    guests = (members.select(*GROUP, F.explode("wide").alias("rid")).distinct().join(homes, [*GROUP, "rid"], "left_anti")
              .select(*GROUP, "rid", F.array().cast("array<long>").alias("near"), F.lit(False).alias("member")))
    nodes = members.select(*GROUP, "rid", "near", F.lit(True).alias("member")).unionByName(guests).join(facts, "rid")
    return saved(nodes.groupBy(*GROUP).applyInPandas(_search_shard(least), "a long, b long, whole boolean").distinct())


def link(vectors: DataFrame, least: float = COSINE, nearest: int = NEAREST) -> DataFrame:
    """Vectors (vec_id, embedding, label) → (vec_id, n_links, component_id, kept), one row each."""
    rows = saved(usable(vectors).select("vec_id", "label", "v", F.xxhash64("v").alias("mark")))
    # equal vectors fold to one; null ids come last
    equal = ["label", "mark", "v"]
    distinct = saved(rows.groupBy(*equal).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
                     .withColumn("twins", F.count("*").over(W.partitionBy("label", "mark")))
                     .withColumn("dim", F.size("v")).withColumn("rid", F.monotonically_increasing_id()))
    bare = distinct.select("label", "dim", "rid", "v")
    schema = T.StructType([*bare.schema.fields, T.StructField("cells", T.ArrayType(T.StringType()))])
    assigned = saved(bare.mapInPandas(_assign(_pivots(bare, bare.count()), nearest), schema))
    folded = saved(fold(assigned, least))
    members = saved(distinct.join(folded, "rid").select("rid", "lead", "gap", "first_id", "n"))
    weights = saved(members.groupBy("lead").agg(F.max("gap").alias("radius"), F.sum("n").alias("rows"), F.count("*").alias("size"),
                                                F.min("first_id").alias("first")))
    pairs = ball_pairs(assigned.join(weights.select(F.col("lead").alias("rid"), "radius"), "rid"), least)

    # pairs of balls that their radii do not decide: members against members, block by block
    blocks = F.ceil(F.col("size") / CELL)
    sizes = weights.select(F.col("lead").alias("ball"), blocks.alias("blocks"))
    open_ = (pairs.where("not whole").select("a", "b")
             .join(sizes.withColumnsRenamed({"ball": "a", "blocks": "of_a"}), "a").join(sizes.withColumnsRenamed({"ball": "b", "blocks": "of_b"}), "b"))

    def side(mine: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("rid", F.lit("block")), F.col(f"of_{mine}")).alias(f"block_{mine}")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"of_{other}") - 1)).alias(f"block_{other}")
        return (open_.join(members.select(F.col("lead").alias(mine), "rid", "n"), mine).join(bare.select("rid", "v"), "rid")
                .select("a", "b", block, "rid", "n", "v", every, F.lit(mine == "a").alias("first")))
    partly = saved(side("a", "b").unionByName(side("b", "a")).groupBy("a", "b", "block_a", "block_b").applyInPandas(
        _compare(least), "a long, b long, rid long, links long"))

    whole = pairs.where("whole").select("a", "b")
    both = whole.union(whole.select("b", "a")).toDF("lead", "to")
    beside = (both.join(weights.select(F.col("lead").alias("to"), "rows"), "to").groupBy("lead").agg(F.sum("rows").alias("beside")))
    joined = components(whole.union(partly.select("a", "b").distinct()))
    balls = (weights.join(beside, "lead", "left").join(joined.withColumnRenamed("node", "lead"), "lead", "left")
             .withColumn("component", F.coalesce("component", "lead")))
    smallest = balls.groupBy("component").agg(F.min("first").alias("component_id"))
    balls = saved(balls.join(smallest, "component").select("lead", (F.col("rows") - 1 + F.coalesce("beside", F.lit(0))).alias("links"), "component_id"))
    extra = partly.groupBy("rid").agg(F.sum("links").alias("extra"))
    facts = (distinct.select(*equal, "rid", "twins").join(folded.select("rid", "lead"), "rid").join(balls, "lead").join(extra, "rid", "left")
             .withColumn("n_links", F.col("links") + F.coalesce("extra", F.lit(0))))
    # the mark names a vector unless two vectors share one; those are told apart by their components
    plain = saved(facts.where("twins = 1").select("label", "mark", "n_links", "component_id"))
    told = facts.where("twins > 1").select(*equal, "n_links", "component_id")
    columns = ["vec_id", "n_links", "component_id"]
    linked = rows.join(plain, ["label", "mark"]).select(*columns).union(rows.join(told, equal).select(*columns))
    alone = vectors.where(~_good(_given(vectors))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(vectors: DataFrame, result: DataFrame, least: float = COSINE) -> DataFrame:
    """(queries, found, wanted, invented): links of every vector with an id divisible by 20, against brute force.

    Counted links are verified and counted once, so with ``invented`` at 0 ``found`` counts identities. The queries
    meet all vectors of their label in 64 blocks.
    """
    rows = usable(vectors).select("vec_id", "label", "v").withColumn("dim", F.size("v"))
    cut = F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int")
    queries = rows.where("vec_id % 20 = 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("query", F.lit(True))
    others = rows.withColumn("other", cut).withColumn("query", F.lit(False))

    def count(part: pd.DataFrame) -> pd.DataFrame:
        q, o = part[part["query"]], part[~part["query"]]
        if q.empty or o.empty:
            return pd.DataFrame({"vec_id": q["vec_id"], "wanted": np.zeros(len(q), np.int64)})
        hit = (unit(q["v"]) @ unit(o["v"]).T >= least) & (q["vec_id"].to_numpy()[:, None] != o["vec_id"].to_numpy()[None, :])
        return pd.DataFrame({"vec_id": q["vec_id"], "wanted": hit.sum(1)})
    wanted = (queries.unionByName(others).groupBy("label", "dim", "other").applyInPandas(count, "vec_id long, wanted long")
              .groupBy("vec_id").agg(F.sum("wanted").alias("wanted")))
    return wanted.join(result.select("vec_id", "n_links"), "vec_id").agg(
        F.count("*").alias("queries"), F.sum(F.least("n_links", "wanted")).alias("found"), F.sum("wanted").alias("wanted"),
        F.sum(F.greatest(F.col("n_links") - F.col("wanted"), F.lit(0))).alias("invented"))
