"""Near-duplicate vectors by an epsilon grid order join.

Vectors of length one have a cosine of at least t exactly if they lie within eps = sqrt(2 - 2t). They are projected
on their leading principal dimensions, a grid of side eps is laid over these, and the vectors are sorted by their
cells in lexicographic order (then by a finer grid, so that a crowded cell is in order too). The sequence is cut into
blocks, ``FAN_OUT`` blocks form an interval of the next level, and so on up to the whole sequence. The join
is recursive: a pair of intervals is skipped if its boxes or balls prove every pair of vectors distant, settled as a
whole if they prove every pair near, and else replaced by the pairs of its halves (here: of its ``FAN_OUT`` parts). Pairs of
blocks that stay open meet in a task, which goes on with the leaves of ``LEAF`` vectors and compares
what remains: first in the leading dimensions, then in double precision in all of them. Dot products that
rounding could put on either side of the threshold are summed exactly, so results do not depend on the blocks.

Scale: exact copies are one vector with a weight. Every step of the recursion is two equi-joins of Spark on the table of
intervals; a task holds two blocks of ``BLOCK_BYTES``. No pair of vectors leaves a task: it returns one row per
linked vector with its number of links and a vector it is tied to, and pairs of intervals that are near as a whole one row.
So a group of near copies that holds a third of all rows costs rows in proportion to its size. The basis of the grid is
fitted on about ``FIT_ROWS`` vectors drawn by hash; it decides what can be skipped, never the result. Vectors
spread evenly over many dimensions leave nothing to skip: all pairs of blocks are then compared.

Defined results: null, empty and zero vectors and those with null or non-finite components link with nothing, and
neither do vectors of different lengths; copies and repeated rows are linked with each other; a null id keeps its row and is
never the smallest id unless its whole component has none (``kept`` then holds for its null ids); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymetrics.llm.common import cut, ranked, ship, small_side
from supplymetrics.llm.simhash import components

ship(__name__)

THRESHOLD = 0.95
LEADING = 16
FINE = 16
FIT_ROWS = 2048
FIT_SEED = 13
BLOCK_BYTES = 1 << 21
LEAST_BLOCKS = 16  # of a sequence that has so many leaves, so that short ones spread over tasks too
FAN_OUT = 8
LEAF = 256
SLACK = 1e-6  # far above the rounding of a distance, far below any eps in use
NODE = ("dim int, node long, first long, n long, weight long, low array<double>, high array<double>, "
        "centre array<double>, radius double")


def reach_of(threshold: float) -> float:
    """The distance of two vectors of length one whose cosine is the threshold."""
    return math.sqrt(max(0.0, 2 - 2 * threshold))


def usable(vector: Column) -> Column:
    """True for vectors that have finite components only, and one other than zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def with_bytes(vector: Column, double: bool) -> Column:
    """(dim, key, vec) of a vector: its length, a digest of its components, and their bytes."""
    kind = "<f8" if double else "<f4"

    @F.pandas_udf("dim int, key binary, vec binary")
    def run(rows: pd.Series) -> pd.DataFrame:
        raw = [(np.asarray(v, kind) + 0).tobytes() for v in rows]  # + 0 turns -0.0 into 0.0
        return pd.DataFrame({"dim": [len(v) for v in rows], "key": [hashlib.blake2b(b, digest_size=16).digest() for b in raw], "vec": raw})

    return run(vector)


def read(vecs: Iterable[bytes], dim: int, double: bool) -> np.ndarray:
    """The vectors scaled to length one, in double precision."""
    rows = np.frombuffer(b"".join(vecs), "<f8" if double else "<f4").astype(np.float64).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


@dataclass
class Basis:
    """Leading principal dimensions by length of vector; lengths that the sample lacks use their first components."""
    fitted: dict[int, np.ndarray]

    def project(self, rows: np.ndarray) -> np.ndarray:
        axes = self.fitted.get(rows.shape[1])
        lead = rows[:, :LEADING] if axes is None else rows @ axes.T
        return np.pad(lead, ((0, 0), (0, LEADING - lead.shape[1])))


def fit(classes: DataFrame, double: bool) -> Basis:
    """The basis from about FIT_ROWS vectors, drawn by the hash of their digest."""
    share = FIT_ROWS / max(1, classes.count())
    drawn = F.pmod(F.xxhash64(F.lit(FIT_SEED), "key"), F.lit(1 << 30)) < min(1.0, share) * (1 << 30)
    by: dict[int, list[bytes]] = {}
    for r in classes.filter(drawn).select("dim", "vec").limit(4 * FIT_ROWS).collect():
        by.setdefault(r.dim, []).append(r.vec)
    fitted = {}
    for dim, vecs in by.items():
        rows = read(vecs, dim, double)
        if len(rows) > 1:
            fitted[dim] = np.linalg.svd(rows - rows.mean(axis=0), full_matrices=False)[2][:LEADING]
    return Basis(fitted)


def grid_order(dim: Column, vec: Column, basis: Basis, double: bool, side: float) -> Column:
    """Sort key of a vector: its cells on the leading dimensions, then those of a grid FINE times finer."""
    @F.pandas_udf("binary")
    def run(dims: pd.Series, vecs: pd.Series) -> pd.Series:
        out = pd.Series([b""] * len(dims), dtype=object)
        for d in dims.unique():
            own = np.flatnonzero(dims.to_numpy() == d)
            lead = basis.project(read(vecs.iloc[own], int(d), double))
            cells = [np.clip(np.floor(lead / s), -32768, 32767) + 32768 for s in (side, side / FINE)]
            for i, key in zip(own, np.hstack(cells).astype(">u2")):
                out.iat[i] = key.tobytes()
        return out

    return run(dim, vec)


def outline(rows: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Box in the leading dimensions, and ball in all of them, of some vectors."""
    centre = rows.mean(axis=0)
    return lead.min(axis=0), lead.max(axis=0), centre, float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))


def make_blocks(ordered: DataFrame, basis: Basis, double: bool) -> DataFrame:
    """One row per block of the sequence: its outline as an interval (NODE), and its vectors and weights as bytes."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        dim = int(rows["dim"].iat[0])
        unit = read(rows["vec"], dim, double)
        low, high, centre, radius = outline(unit, basis.project(unit))
        return pd.DataFrame([(dim, rows["node"].iat[0], rows["rank"].iat[0], len(rows), rows["weight"].sum(), low, high, centre, radius,
                              b"".join(rows["vec"]), rows["weight"].to_numpy("<i8").tobytes())], columns=[c.split()[0] for c in schema.split(", ")])

    schema = f"{NODE}, vecs binary, weights binary"
    return ordered.select("dim", "node", "rank", "weight", "vec").groupBy("dim", "node").applyInPandas(pack, schema)


def parents(nodes: DataFrame) -> DataFrame:
    """The intervals of the next level, FAN_OUT nodes each."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        centres, sizes = np.stack(list(rows["centre"])), rows["n"].to_numpy()
        centre = np.average(centres, axis=0, weights=sizes)
        radius = (np.sqrt(((centres - centre) ** 2).sum(axis=1)) + rows["radius"].to_numpy()).max()
        return pd.DataFrame([(rows["dim"].iat[0], rows["node"].iat[0] // FAN_OUT, rows["first"].iat[0], sizes.sum(), rows["weight"].sum(),
                              np.stack(list(rows["low"])).min(axis=0), np.stack(list(rows["high"])).max(axis=0), centre, radius)], columns=names)

    names = [c.split()[0] for c in NODE.split(", ")]
    grouped = nodes.withColumn("up", F.expr(f"node div {FAN_OUT}")).groupBy("dim", "up")
    return grouped.applyInPandas(lambda rows: merge(rows.drop(columns="up")), NODE)


FAR, OPEN, NEAR = 0, 1, 2


def judge(gap2: np.ndarray, between: np.ndarray, radii: np.ndarray, reach: float) -> np.ndarray:
    """FAR, OPEN or NEAR from squared gaps of boxes, distances of centres and sums of radii."""
    far = (gap2 > (reach + SLACK) ** 2) | (between - radii > reach + SLACK)
    return np.where(far, FAR, np.where(between + radii < reach - SLACK, NEAR, OPEN))


def verdict(reach: float) -> Column:
    """FAR, OPEN or NEAR of the intervals ``a`` and ``b`` of a row."""
    @F.pandas_udf("int")
    def run(al: pd.Series, ah: pd.Series, ac: pd.Series, ar: pd.Series, bl: pd.Series, bh: pd.Series, bc: pd.Series, br: pd.Series) -> pd.Series:
        if not len(al):
            return pd.Series([], dtype="int32")
        al, ah, bl, bh = (np.stack(list(x)) for x in (al, ah, bl, bh))
        gap = np.maximum(0, np.maximum(al - bh, bl - ah))
        between = np.array([np.linalg.norm(x - y) for x, y in zip(ac, bc)])
        return pd.Series(judge((gap * gap).sum(axis=1), between, (ar + br).to_numpy(), reach).astype("int32"))

    return run(*[f"{side}.{c}" for side in "ab" for c in ("low", "high", "centre", "radius")])


def expand(pairs: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """The pairs (dim, a, b, verdict) of parts of the open ``pairs(dim, a, b)`` that are not far apart."""
    parts = nodes.select(F.col("dim").alias("part_dim"), F.expr(f"node div {FAN_OUT}").alias("up"),
                         F.struct("node", "first", "weight", "low", "high", "centre", "radius").alias("part"))
    left = pairs.join(parts, (F.col("dim") == F.col("part_dim")) & (F.col("a") == F.col("up"))).select("dim", F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("part").alias("a"))
    both = left.join(parts, (F.col("dim") == F.col("part_dim")) & (F.col("ub") == F.col("up"))).select("dim", "ua", "ub", "a", F.col("part").alias("b"))
    met = both.filter((F.col("ua") != F.col("ub")) | (F.col("a.node") <= F.col("b.node"))).withColumn("verdict", verdict(reach))

    def brief(side: str) -> Column:
        return F.struct(*[f"{side}.{c}" for c in ("node", "first", "weight")]).alias(side)

    return met.filter(F.col("verdict") != FAR).select("dim", brief("a"), brief("b"), "verdict")


def roots_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the edges u - v."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[u], root[v]), root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


class Block:
    """The vectors of a block in a task, cut into leaves."""

    def __init__(self, dim: int, first: int, vecs: bytes, weights: bytes, basis: Basis, double: bool):
        self.first, self.weights = first, np.frombuffer(weights, "<i8").astype(np.float64)
        self.units = read([vecs], dim, double)
        lead = basis.project(self.units)
        self.lead, self.lead2 = lead.astype(np.float32), (lead * lead).sum(axis=1).astype(np.float32)
        self.leaves = [slice(i, min(i + LEAF, len(lead))) for i in range(0, len(lead), LEAF)]
        low, high, centre, radius = zip(*[outline(self.units[s], lead[s]) for s in self.leaves])
        self.low, self.high, self.centre, self.radius = np.stack(low), np.stack(high), np.stack(centre), np.array(radius)


def dots(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the dot products of rows reach the threshold; those that rounding could move are summed exactly."""
    dot = np.einsum("ij,ij->i", a, b)
    for i in np.flatnonzero(np.abs(dot - threshold) < 1e-11):
        dot[i] = math.fsum((a[i] * b[i]).tolist())
    return dot >= threshold


def linked(a: Block, b: Block, s: slice, t: slice, reach: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (within the leaves) of the linked pairs of a leaf of a and one of b."""
    near = a.lead2[s, None] + b.lead2[None, t] - 2 * (a.lead[s] @ b.lead[t].T) <= np.float32(reach * reach + 1e-4)
    i, j = np.nonzero(near)
    if 8 * len(i) > near.size:  # many are left: all products at once, then a closer look at those near the threshold
        dot = a.units[s] @ b.units[t].T
        sure = dot >= threshold + 1e-11
        p, q = np.nonzero(~sure & (dot > threshold - 1e-11))
        if len(p):
            sure[p, q] = dots(a.units[s][p], b.units[t][q], threshold)
        return np.nonzero(sure)
    ok = dots(a.units[s][i], b.units[t][j], threshold)
    return i[ok], j[ok]


def meet(a: Block, b: Block, reach: float, threshold: float) -> pd.DataFrame:
    """(rank, n, root) of the linked vectors of two blocks (or of one with itself): the weight they are linked with, and one that all of a component are tied to."""
    same = a.first == b.first
    na, nb = len(a.units), len(b.units)
    shift = 0 if same else na
    count = np.zeros(na + (0 if same else nb))
    gap = np.maximum(0, np.maximum(a.low[:, None] - b.high[None], b.low[None] - a.high[:, None]))
    between = np.sqrt(((a.centre[:, None] - b.centre[None]) ** 2).sum(axis=2))
    verdicts = judge((gap * gap).sum(axis=2), between, a.radius[:, None] + b.radius[None], reach)
    edges = []
    for x, y in zip(*np.nonzero(verdicts)):
        if same and x > y:
            continue
        s, t = a.leaves[x], b.leaves[y]
        wa, wb = a.weights[s], b.weights[t]
        if verdicts[x, y] == NEAR:
            i, j = np.concatenate([np.arange(len(wa)), np.zeros(len(wb), int)]), np.concatenate([np.zeros(len(wa), int), np.arange(len(wb))])
            from_b, from_a = np.full(len(wa), wb.sum()), np.full(len(wb), wa.sum())
        else:
            i, j = linked(a, b, s, t, reach, threshold)
            if same and x == y:  # every vector is linked with itself, whatever rounding does
                off = i != j
                i, j = np.concatenate([i[off], np.arange(len(wa))]), np.concatenate([j[off], np.arange(len(wa))])
            from_b, from_a = np.bincount(i, wb[j], len(wa)), np.bincount(j, wa[i], len(wb))
        count[s] += from_b
        if not (same and x == y):
            count[t.start + shift:t.stop + shift] += from_a
        if len(i) > len(wa) + len(wb):
            local = roots_of(len(wa) + len(wb), i, j + len(wa))
            used = np.flatnonzero(local != np.arange(len(local)))
            u, v = local[used], used
            place = np.concatenate([np.arange(s.start, s.stop), np.arange(t.start, t.stop) + shift])
            edges.append((place[u], place[v]))
        else:
            edges.append((i + s.start, j + t.start + shift))
    u, v = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, int) for k in (0, 1))
    root = roots_of(len(count), u, v)
    rank = np.concatenate([a.first + np.arange(na), [] if same else b.first + np.arange(nb)]).astype(np.int64)
    own = np.flatnonzero(count)
    return pd.DataFrame({"rank": rank[own], "n": np.rint(count[own]).astype(np.int64), "root": rank[root[own]]})


def block_links(pairs: DataFrame, blocks: DataFrame, basis: Basis, double: bool, threshold: float) -> DataFrame:
    """(rank, n, root) from comparing the open ``pairs(dim, a, b)`` of blocks."""
    reach = reach_of(threshold)

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                a = Block(r.dim, r.a_first, r.a_vecs, r.a_weights, basis, double)
                b = a if r.a_first == r.b_first else Block(r.dim, r.b_first, r.b_vecs, r.b_weights, basis, double)
                yield meet(a, b, reach, threshold)

    def side(name: str) -> DataFrame:
        return blocks.select(F.col("dim").alias(f"{name}_dim"), F.col("node").alias(f"{name}_node"),
                             *[F.col(c).alias(f"{name}_{c}") for c in ("first", "vecs", "weights")])

    def on(name: str) -> Column:
        return (F.col("dim") == F.col(f"{name}_dim")) & (F.col(name) == F.col(f"{name}_node"))

    # either block may come first; taking turns keeps a late block from being the second one of all its pairs
    turn = (F.col("a") + F.col("b")) % 2 == 0
    turned = pairs.select("dim", F.when(turn, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("b"))
    rows = turned.join(side("a"), on("a")).join(side("b"), on("b"))
    return rows.select("dim", "a_first", "a_vecs", "a_weights", "b_first", "b_vecs", "b_weights").mapInPandas(compare, "rank long, n long, root long")


def whole_links(near: list[DataFrame], levels: list[DataFrame], members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What pairs of intervals that are near as a whole mean for their vectors: (rank, n, root), and ties (a, b).

    ``near[l]`` holds pairs of ``levels[l]``. What a node is linked with is handed down to its parts, level by level.
    """
    down, ties = None, None
    for level in range(len(levels) - 1, -1, -1):
        pairs = near[level]
        add = pairs.select("dim", F.col("a.node").alias("node"), F.col("b.weight").alias("n")).unionByName(
            pairs.filter("a.node <> b.node").select("dim", F.col("b.node").alias("node"), F.col("a.weight").alias("n")))
        tied = pairs.select(F.col("a.first").alias("a"), F.col("b.first").alias("b"))
        if down is not None:
            parts = levels[level].select("dim", F.expr(f"node div {FAN_OUT}").alias("up"), "node", "first")
            passed = parts.join(down, ["dim", "up"])
            add = add.unionByName(passed.select("dim", "node", "n"))
            tied = tied.unionByName(passed.select(F.col("top").alias("a"), F.col("first").alias("b")))
        ties = tied if ties is None else ties.unionByName(tied)
        add = add.groupBy("dim", "node").agg(F.sum("n").alias("n"))
        down = cut(add.join(levels[level].select("dim", "node", "first"), ["dim", "node"]).select("dim", F.col("node").alias("up"), "n", F.col("first").alias("top")))
    own = members.join(down.withColumnRenamed("up", "node"), ["dim", "node"]).select("rank", "n", F.col("top").alias("root"))
    return own, ties.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def join_sequence(ordered: DataFrame, basis: Basis, double: bool, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rank, n): the weight each vector is linked with, its own included; and (node, root) of tied ranks."""
    reach = reach_of(threshold)
    blocks = cut(make_blocks(ordered, basis, double))
    levels = [blocks.drop("vecs", "weights")]
    while levels[-1].groupBy("dim").count().filter("count > 1").limit(1).count():
        levels.append(cut(parents(levels[-1])))
    none = levels[0].select("dim", F.struct("node", "first", "weight").alias("a"), F.struct("node", "first", "weight").alias("b"), F.lit(NEAR).alias("verdict")).limit(0)
    near: list[DataFrame] = [none] * len(levels)
    # above the top there is one interval a length, numbered as the top's parent
    up = F.expr(f"node div {FAN_OUT}")
    pairs = levels[-1].select("dim", up.alias("a"), up.alias("b"))
    for level in range(len(levels) - 1, -1, -1):
        met = cut(expand(pairs, levels[level], reach))
        near[level] = met.filter(F.col("verdict") == NEAR)
        pairs = met.filter(F.col("verdict") == OPEN).select("dim", F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    found = cut(block_links(pairs, blocks, basis, double, threshold))
    ties = None
    if any(not pairs.isEmpty() for pairs in near):
        own, ties = whole_links(near, levels, ordered.select("dim", "node", "rank"))
        found = found.unionByName(cut(own))
    edges = found.filter("root <> rank").select(F.least("root", "rank").alias("a"), F.greatest("root", "rank").alias("b"))
    edges = edges if ties is None else edges.unionByName(ties)
    return found.groupBy("rank").agg(F.sum("n").alias("n")), components(edges.distinct())


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    double = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    rows = vectors.select("vec_id", (F.col("embedding").cast("array<double>") if double else F.col("embedding")).alias("v"))
    rows = rows.withColumn("usable", usable(F.col("v")))
    whole = cut(rows.filter("usable").select("vec_id", with_bytes(F.col("v"), double).alias("x")).select("vec_id", "x.*"))
    classes = cut(whole.groupBy("key").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"),
                                           F.min("vec_id").alias("first_id")))
    basis = fit(classes, double)
    order = grid_order(F.col("dim"), F.col("vec"), basis, double, max(reach_of(threshold), 1e-3))
    placed = ranked(classes.withColumn("grid", order), "dim", "grid", "key")
    starts = small_side(cut(placed.groupBy("dim").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("length"))))
    width = 8 if double else 4
    size = F.greatest(F.lit(LEAF), F.least(F.expr(f"{block_bytes} div (dim * {width})"), F.ceil(F.col("length") / LEAST_BLOCKS))).cast("long")
    ordered = cut(placed.join(starts, "dim").select("dim", "rank", "key", "vec", "weight", "first_id", F.floor((F.col("rank") - F.col("start")) / size).alias("node")))

    counts, tied = join_sequence(ordered, basis, double, threshold)
    known = ordered.select("rank", "key", "first_id").join(counts, "rank").join(tied, F.col("rank") == F.col("node"), "left")
    known = cut(known.select("key", "first_id", F.col("n"), F.coalesce("root", "rank").alias("root")))
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    facts = known.join(smallest, "root").select("key", F.lit(True).alias("joined"), (F.col("n") - 1).alias("n_links"), "component_id")
    of_usable = whole.select("vec_id", "key").join(facts, "key").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_usable.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
