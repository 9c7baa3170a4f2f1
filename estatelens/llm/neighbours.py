"""Nearest neighbours by collision-counting hashing.

Vectors are hashed by single random projections, each kept as one sorted array.
A query collides with a vector in a projection if their values differ by no more
than the window's half-width, which is the radius. Windows are centred on the query
and expanded by virtual rehashing: the radius grows, and only the new ends of each
window are read. A vector that collides in enough projections is verified by
its exact cosine. The radius grows by a factor, but never past the distance of the
k-th best verified vector: once that lies within the radius, the query ends.

Vectors are dealt into blocks of bounded size and queries too; each pair of
blocks is one group, with an index of the block's vectors. The best of each
block are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OUT = "query_id bigint, vec_id bigint, score double"
_WITHIN = 0.6827  # of a normal variable, within its standard deviation
_BLOCK_BYTES = 64 << 20


def directions(length: int, projections: int, seed: int) -> np.ndarray:
    """Random directions, as columns, orthogonal in groups of ``length``; their squares add up like those of normal ones."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.standard_normal((length, length)))[0] for _ in range(-(-projections // length))]
    return np.sqrt(length) * np.concatenate(groups, axis=1)[:, :projections]


class Index:
    """Sorted projections of unit vectors.

    A vector at the radius collides in a projection with probability 0.68. It is verified if
    it collides in as many projections as that lets expect, less ``slack`` standard deviations:
    1.4 of them miss about one in twelve of the vectors at the radius, and fewer within.
    """

    def __init__(self, units: np.ndarray, projections: int = 128, slack: float = 1.4, seed: int = 7):
        self.units = units
        n, length = units.shape
        self.directions = directions(length, projections, seed)
        values = (units @ self.directions).T
        order = np.argsort(values, axis=1, kind="stable")
        # one array for all projections: each has a range of its own
        self.reach = 2 * np.sqrt(length) + 1
        self.shift = np.arange(projections) * 4 * self.reach
        self.values = (np.take_along_axis(values, order, axis=1) + self.shift[:, None]).ravel()
        self.order = order.ravel()
        spread = np.sqrt(_WITHIN * (1 - _WITHIN) * projections)
        self.threshold = max(1, int(np.ceil(_WITHIN * projections - slack * spread)))

    def _added(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each vector stands in the ranges of the sorted arrays."""
        parts = [self.order[a:b] for a, b in zip(begin.tolist(), end.tolist()) if a < b]
        found = np.concatenate(parts) if parts else self.order[:0]
        return np.bincount(found, minlength=len(self.units))

    def candidates(
        self, query: np.ndarray, k: int, ids: np.ndarray, own: int, start: float = 0.25, growth: float = 1.25
    ) -> tuple[np.ndarray, float]:
        """Rows that were verified until ``k`` distinct ids other than ``own`` lay within the radius, and how far they lay."""
        n = len(self.units)
        centre = query @ self.directions
        low = high = np.searchsorted(self.values, centre + self.shift)
        hits = np.zeros(n, np.int64)
        verified = np.zeros(n, bool)
        distance = np.full(n, np.inf)
        others = ids != own
        radius = start
        while True:
            a = np.searchsorted(self.values, np.maximum(centre - radius, -self.reach) + self.shift, "left")
            b = np.searchsorted(self.values, np.minimum(centre + radius, self.reach) + self.shift, "right")
            a, b = np.minimum(a, low), np.maximum(b, high)
            hits += self._added(np.concatenate((a, high)), np.concatenate((low, b)))
            low, high = a, b
            new = np.flatnonzero((hits >= self.threshold) & ~verified)
            verified[new] = True
            distance[new] = np.sqrt(np.maximum(0, 2 - 2 * (self.units[new] @ query)))
            known = np.flatnonzero(verified & others)
            nearest = known[np.argsort(distance[known], kind="stable")]
            _, first = np.unique(ids[nearest], return_index=True)
            best = np.sort(distance[nearest[first]])
            kth = best[k - 1] if len(best) >= k else np.inf
            if kth <= radius or verified.all() or radius > 2 * self.reach:
                return np.flatnonzero(verified), min(radius, kth)
            radius = min(radius * growth, max(kth, radius * 1.0001))


    def searched(self, queries: np.ndarray, owns: np.ndarray, k: int, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each query's number and its candidates, by the queries' own ids.

        Windows start a little below the distances that the last queries needed.
        """
        needed: list[float] = []
        for q in np.argsort(owns, kind="stable").tolist():
            start = 0.8 * float(np.median(needed[-32:])) if needed else 0.25
            found, distance = self.candidates(queries[q], k, ids, owns[q], max(start, 0.01))
            needed.append(distance)
            yield q, found


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, scaled by powers of two so that their squares neither vanish nor overflow, and their lengths."""
    _, exponent = np.frexp(np.abs(rows).max(1))
    rows = np.ldexp(rows, -exponent[:, None])
    return rows, np.sqrt((rows * rows).sum(1))


def _search(k: int, options: dict):
    def run(key, data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if data.num_rows and queries.num_rows:
            ids, rows = _matrix(data)
            asked, wanted = _matrix(queries)
            (rows, norms), (wanted, lengths) = _units(rows), _units(wanted)
            index = Index(rows / norms[:, None], **options)
            # one more than k, so that no block looks less far than one with the query's own row
            for q, found in index.searched(wanted / lengths[:, None], asked, k + 1, ids):
                found = found[ids[found] != asked[q]]
                score = (rows[found] * wanted[q]).sum(1) / (norms[found] * lengths[q])
                best = np.lexsort((ids[found], -score))
                _, first = np.unique(ids[found][best], return_index=True)  # the nearest row of each id
                best = best[np.sort(first)[:k]]
                out.append((np.full(len(best), asked[q]), ids[found][best], score[best]))
        parts = [np.concatenate(x) for x in zip(*out)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), parts)))

    return run


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    values = table.column("v").chunk(0)
    return table.column("vec_id").to_numpy(), values.flatten().to_numpy().reshape(len(values), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles, without those that are null, zero, or hold null or non-finite components."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        .where("vec_id is not null and v is not null")
        .where(fine & F.exists("v", lambda x: x != 0))
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 32768, least_block: int = 4096, **options
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of ``vectors`` by cosine that were found for each query.

    Both tables have vec_id and embedding. A query's own vec_id is no candidate.
    Ties go to the smaller vec_id; fewer rows than ``k`` if there are fewer
    candidates. Rows without a vec_id and unusable vectors take no part; vectors
    are compared with those of their own length. Of rows that repeat a query's
    vec_id the smallest vector is the query; of repeated candidates the nearest
    counts. Every vector is indexed; ``options`` go to the index. A block has at most
    ``block`` vectors and about 64 MB of them.
    """
    spark = vectors.sparkSession
    data = usable(vectors).distinct()
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, longest = data.agg(F.count("*"), F.max(F.size("v"))).first()
    n_asked = asked.count()
    block = max(1, min(block, _BLOCK_BYTES // (8 * (longest or 1))))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // block), min(parallel, -(-n // least_block)), 1)
    rounds = max(-(-n_asked // block), 1)

    def each(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def number(count: int):
        return F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")

    length = F.size("v").alias("length")
    dealt = data.select("vec_id", "v", length, number(blocks).alias("b"), each(rounds).alias("r"))
    sought = asked.select("vec_id", "v", length, number(rounds).alias("r"), each(blocks).alias("b"))
    keys = ["length", "b", "r"]
    found = dealt.groupBy(*keys).cogroup(sought.groupBy(*keys)).applyInArrow(_search(k, options), _OUT)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
