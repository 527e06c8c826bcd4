"""Centroid clustering on bit planes: exact k-means rounds over small-integer vectors.

A component x becomes the integer floor(64 * x). The 64 integers of a vector are packed by bit plane: plane j holds
bit j of all components in one 64-bit word, the last plane is the sign. A dot product with a centroid is then the sum
over pairs of planes of weight times popcount(AND), so squared distances |v|^2 - 2 v.c + |c|^2 are exact integers
and no round depends on the order of rows. The sums behind new centroids are positional popcounts of the planes.

Scale: vectors are packed once and kept in a reliable checkpoint (some 8 words a vector), no round shuffles them. A
round emits at most (centroids x 64) partial sums per Arrow batch, which Spark adds up by key; the driver holds
the centroids alone (k x 64 integers). A cluster that holds most rows is a key of many partial sums, not a group.

Defined results: vectors that are null, have not 64 components, or hold null or non-finite ones are left out; a
component outside +-2^27 after scaling is clipped there, so that any squared distance fits a long, and an inertia that
fits none is null; of equal distances the smaller number wins; repeated rows are vectors of their own, and may both start a centroid (different vectors of one id in the
order of a hash); a null id comes after all
others among the starts; fewer vectors than centroids give fewer clusters; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymetrics.llm.bits import bit_planes, plane_sums, plane_weights, planes_dot
from supplymetrics.llm.common import cut, ship

ship(__name__)

COMPONENTS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
START_SEED = "1"
LIMIT = 1 << 27


def usable(vector: Column, components: int = COMPONENTS) -> Column:
    """True for vectors of exactly ``components`` finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == components) & finite, F.lit(False))


def as_integers(vector: Column) -> Column:
    """floor(SCALE * x) of every component, x as double, at most LIMIT in size."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT).cast("long"), F.least(
        F.lit(LIMIT).cast("long"), F.floor(F.greatest(F.lit(-1e17), F.least(F.lit(1e17), F.lit(float(SCALE)) * x))).cast("long"))))


def pack(vectors: Column) -> Column:
    """Bit planes of arrays of 64 longs, each plane one (signed) long."""
    @F.pandas_udf("array<long>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(list(bit_planes(np.stack(list(rows))).view(np.int64)) if len(rows) else [], dtype=object)

    return run(vectors)


def unpacked(planes: pd.Series) -> np.ndarray:
    """Planes of a batch as an n x planes array of words, signs extended to the largest number of planes."""
    lengths = planes.map(len)
    most = lengths.max()
    if lengths.min() < most:
        planes = [np.append(p, [p[-1]] * (most - len(p))) for p in planes]
    return np.stack(list(planes)).astype(np.int64).view(np.uint64)


class Centroids:
    """The centroids of a round, as rows of integers and as bit planes."""

    def __init__(self, rows: Sequence[Sequence[int]]):
        self.rows = [list(map(int, r)) for r in rows]
        self.planes = bit_planes(np.array(self.rows, np.int64).reshape(-1, COMPONENTS))

    def nearest(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance of every packed vector."""
        norms = sum_of_squares(words)
        best, at = None, None
        for k, (row, planes) in enumerate(zip(self.rows, self.planes)):
            distance = norms - 2 * planes_dot(words, planes) + sum(x * x for x in row)
            if best is None:
                best, at = distance, np.zeros(len(words), np.int32)
            else:
                at[distance < best] = k
                best = np.minimum(best, distance)
        return at, best

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[k])).encode()).hexdigest()


def sum_of_squares(words: np.ndarray) -> np.ndarray:
    """Exact squared lengths of packed vectors, from the AND-popcounts of their own planes."""
    total, weights = np.zeros(len(words), np.int64), plane_weights(words.shape[1])
    for i, wi in enumerate(weights):
        for j, wj in enumerate(weights[:i + 1]):
            total += (1 if i == j else 2) * wi * wj * np.bitwise_count(words[:, i] & words[:, j]).astype(np.int64)
    return total


def as_long(value: int) -> int | None:
    return value if value < 1 << 63 else None


def starts(packed: DataFrame, k: int) -> list[list[int]]:
    """Components of the k vectors with the smallest seeded hash of their id; a bounded top-k."""
    rank = F.sha2(F.concat(F.lit(f"{START_SEED}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = packed.orderBy(rank.asc_nulls_last(), "tie").limit(k).select("planes").collect()
    return [plane_sums(np.array([r.planes], np.int64).view(np.uint64)).tolist() for r in rows]


def moved(packed: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after one round: exact floor of the mean of each cluster; an empty one stays."""
    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                words = unpacked(batch["planes"])
                cluster, _ = centroids.nearest(words)
                for k in np.unique(cluster):
                    own = words[cluster == k]
                    yield pd.DataFrame({"cluster": k, "component": np.arange(COMPONENTS, dtype=np.int32), "total": plane_sums(own), "n": len(own)})

    added = packed.select("planes").mapInPandas(sums, "cluster int, component int, total long, n long")
    rows = [list(r) for r in centroids.rows]
    for r in added.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        rows[r.cluster][r.component] = r.total // r.n
    return Centroids(rows)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid."""
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")))
    whole = kept.select("vec_id", as_integers(F.col("v")).alias("v"))
    packed = cut(whole.select("vec_id", pack(F.col("v")).alias("planes"), F.xxhash64("v").alias("tie")))
    centroids = Centroids(starts(packed, k))
    for _ in range(rounds if centroids.rows else 0):
        centroids = moved(packed, centroids)

    @F.pandas_udf("cluster int, distance long")
    def assign(planes: pd.Series) -> pd.DataFrame:
        at, distance = centroids.nearest(unpacked(planes)) if len(planes) else ([], [])
        return pd.DataFrame({"cluster": at, "distance": distance})

    placed = cut(packed.select("vec_id", assign("planes").alias("at")).select("vec_id", "at.cluster", "at.distance"))
    spread = {r.cluster: int(r.inertia) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    facts = [(c, as_long(spread[c]), as_long(sum(spread.values())), centroids.digest(c), centroids.rows[c]) for c in sorted(spread)]
    session = vectors.sparkSession
    known = session.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return placed.join(F.broadcast(known), "cluster")  # one row per centroid
