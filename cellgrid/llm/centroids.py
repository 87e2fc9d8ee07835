"""Centroid clustering of integer vectors by equal-average equal-variance search.

For vectors x and c of D components with means m and deviations
s = sqrt(sum((x - m) ** 2)),

    |x - c|^2  >=  D (m_x - m_c)^2 + (s_x - s_c)^2  >=  D (m_x - m_c)^2.

The centroids are sorted by mean.  A vector starts at its own mean and walks
outward, always to the side whose next centroid is closer in mean.  Once the
mean term alone exceeds the best distance, all that lies further out is
rejected too; a centroid whose mean and deviation terms exceed it is passed
over.  What is left gets its exact integer distance.  Equal distances are never
rejected, so that the smaller centroid number wins.

Every round is one pass over the vectors: a task adds up its vectors by
centroid and hands on one row per centroid and component, however many vectors
it reads.  Only centroids (k times D integers) travel to and from the driver.

Defined results: vectors of another length, NULL vectors and vectors with NULL
or non-finite components are left out.  Components so large that a squared
distance may not fit 64 bits are worked on as Python integers; a distance or
inertia that does not fit a long is NULL.  Equal vectors and equal ids are rows
of their own.  A NULL id counts as the text ``null`` in the hash that picks the
first centroids; equal hashes are ordered by the vectors.  With fewer vectors
than ``k`` there are fewer centroids; an empty table gives an empty result.
Columns to keep are carried in one struct, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from cellgrid.session import durable

SCALE = 1024
# Component sums are handed on in digits of so many bits, so that no sum overflows.
DIGIT = 40
# Vectors compared at a time in one task.
ROWS = 8192


def whole(x: float) -> int:
    """floor(1024 x) of any finite double, as an exact integer."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def large(size: int) -> int:
    """Below this, the squared distance of two vectors of ``size`` integers fits 64 bits."""
    return math.isqrt(((1 << 63) - 1) // size) // 2


def integers(flat: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``size`` integers: 64-bit ones, or Python integers if some are large."""
    flat = np.asarray(flat, dtype=np.float64)
    if len(flat) and np.abs(flat).max() * SCALE >= large(size) - 1:
        return np.array([whole(float(x)) for x in flat], dtype=object).reshape(-1, size)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, size)


class Search:
    """Nearest centroids; ties go to the smaller number."""

    def __init__(self, centroids: list[list[int]]):
        self.size = len(centroids[0])
        if any(abs(v) >= large(self.size) for c in centroids for v in c):
            self.exact = np.array(centroids, dtype=object)
            return
        self.exact = np.array(centroids, dtype=np.int64)
        self.mean, self.deviation = self._moments(self.exact)
        self.order = np.argsort(self.mean, kind="stable")
        self.sorted_mean = self.mean[self.order]

    def _moments(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = vectors.sum(axis=1)
        square = (vectors * vectors).sum(axis=1)
        # integer until the last step: no cancellation of near-equal squares
        if len(vectors) and int(np.abs(vectors).max()) * self.size >= 1 << 31:
            total, square = total.astype(object), square.astype(object)
        spread = self.size * square - total**2
        return total.astype(np.float64) / self.size, np.sqrt(spread.astype(np.float64) / self.size)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid number and squared distance of every row."""
        exact = self.exact
        if vectors.dtype == object or exact.dtype == object:
            vectors, exact = vectors.astype(object), exact.astype(object)
        n, k = len(vectors), len(exact)
        if exact.dtype == object:
            return self._all(vectors, exact)
        mean, deviation = self._moments(vectors)
        right = np.searchsorted(self.sorted_mean, mean)
        left = right - 1
        best = np.zeros(n, dtype=exact.dtype)
        number = np.full(n, -1, dtype=np.int64)
        live = np.arange(n)
        for _ in range(k):
            lo, hi, m = left[live], right[live], mean[live]
            gap_lo = np.where(lo >= 0, m - self.sorted_mean[np.maximum(lo, 0)], np.inf)
            gap_hi = np.where(hi < k, self.sorted_mean[np.minimum(hi, k - 1)] - m, np.inf)
            downward = gap_lo <= gap_hi
            gap = np.where(downward, gap_lo, gap_hi)
            left[live[downward]] -= 1
            right[live[~downward]] += 1
            place = self.order[np.where(downward, lo, np.minimum(hi, k - 1))]
            bound = self._bound(best[live], number[live] < 0)
            by_mean = self.size * gap * gap
            going = by_mean <= bound
            by_both = by_mean + (deviation[live] - self.deviation[place]) ** 2
            near = np.flatnonzero(going & (by_both <= bound))
            rows, chosen = live[near], place[near]
            apart = vectors[rows] - exact[chosen]
            distance = (apart * apart).sum(axis=1)
            won = (number[rows] < 0) | (distance < best[rows]) | ((distance == best[rows]) & (chosen < number[rows]))
            best[rows[won]], number[rows[won]] = distance[won], chosen[won]
            live = live[going]
            if not len(live):
                break
        return number, best

    @staticmethod
    def _all(vectors: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every centroid tried: doubles are too coarse to reject by for such integers."""
        apart = [((vectors - c) ** 2).sum(axis=1) for c in exact]
        pairs = [min(zip(row, range(len(exact)))) for row in zip(*apart)]
        return np.array([c for _, c in pairs], dtype=np.int64), np.array([d for d, _ in pairs], dtype=object)

    @staticmethod
    def _bound(best: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """The best distance, raised by more than the rounding of the two terms; at first there is none."""
        return np.where(unknown, np.inf, best * (1 + 1e-9) + 1e-3)


def vectors_of(df: DataFrame, vector: str, size: int, carry: list[str]) -> DataFrame:
    """``row`` (a struct of the carried columns) and the vectors ``v`` of usable rows."""
    v = f"`{vector}`"
    usable = f"size({v}) = {size} AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return df.where(f"{v} IS NOT NULL AND {usable}").select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.expr(f"cast({v} AS array<double>)").alias("v")
    )


def first_centroids(df: DataFrame, id: str, vector: str, size: int, k: int, prefix: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``prefix`` and id."""
    usable = vectors_of(df, vector, size, [id])
    key = F.concat(F.lit(prefix), F.coalesce(F.col(f"row.`{id}`").cast("string"), F.lit("null")))
    picked = usable.select(F.sha2(key, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [[whole(x) for x in r.v] for r in picked]


def blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, integers(piece.column("v").flatten().to_numpy(zero_copy_only=False), size)


def digits(value: int) -> list[int]:
    """Base 2^40 digits, lowest first; the last one carries the sign."""
    out = []
    while abs(value) >= 1 << DIGIT:
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


def sums(vectors: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Component sums and sizes of all clusters."""
    size = len(centroids[0])

    def run(batches):
        search = Search(centroids)
        totals = [[0] * size for _ in centroids]
        counts = [0] * len(centroids)
        for _, block in blocks(batches, size):
            number, _ = search.nearest(block)
            for c in np.unique(number):
                own = block[number == c]
                counts[c] += len(own)
                totals[c] = [a + int(b) for a, b in zip(totals[c], own.sum(axis=0))]
        rows = [
            (c, at, place, digit)
            for c, n in enumerate(counts)
            if n
            for at, value in enumerate([*totals[c], n])
            for place, digit in enumerate(digits(value))
        ]
        yield pa.RecordBatch.from_pydict(
            {name: [r[i] for r in rows] for i, name in enumerate(names)},
            schema=pa.schema([("c", pa.int32()), ("at", pa.int32()), ("place", pa.int32()), ("digit", pa.int64())]),
        )

    names = ("c", "at", "place", "digit")
    parts = vectors.select("v").mapInArrow(run, "c int, at int, place int, digit long")
    table = [[0] * (size + 1) for _ in centroids]
    # at most k (D + 1) rows for each digit of the largest sum
    for r in parts.groupBy("c", "at", "place").agg(F.sum("digit").alias("digit")).collect():
        table[r.c][r.at] += r.digit << (DIGIT * r.place)
    return [row[:size] for row in table], [row[size] for row in table]


def fit(vectors: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """``rounds`` times: assign all, then move each non-empty centroid to its floored mean."""
    for _ in range(rounds):
        totals, counts = sums(vectors, centroids)
        moved = [[s // n for s in t] if n else c for t, n, c in zip(totals, counts, centroids)]
        if moved == centroids:
            break  # every later round gives the same centroids
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``row``, ``cluster`` and ``distance`` of every vector."""
    size = len(centroids[0])
    schema = StructType([*vectors.select("row").schema.fields])
    schema = schema.add("cluster", IntegerType()).add("distance", LongType())

    def run(batches):
        search = Search(centroids)
        for piece, block in blocks(batches, size):
            number, distance = search.nearest(block)
            if distance.dtype == object:
                distance = [int(d) if d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays(
                [piece.column("row"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                names=["row", "cluster", "distance"],
            )

    return vectors.mapInArrow(run, schema)


def cluster(
    df: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    size: int = 64,
    k: int = 8,
    rounds: int = 10,
    prefix: str = "3:",
    carry: list[str] | None = None,
) -> tuple[DataFrame, list[list[int]]]:
    """Assigned vectors and the final centroids.

    The frame has ``row`` (struct of the carried columns, by default all but the
    vector), ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``.
    """
    carry = [c for c in df.columns if c != vector] if carry is None else carry
    vectors = vectors_of(df, vector, size, carry)
    centroids = first_centroids(df, id, vector, size, k, prefix)
    if not centroids:
        nothing = "CAST(NULL AS int) AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia"
        return vectors.where("false").selectExpr("row", *nothing, "'' AS centroid_sha256"), []
    centroids = fit(vectors, centroids, rounds)
    placed = durable(assign(vectors, centroids))
    # one row per cluster; a distance that does not fit makes its sums unknown
    found = placed.groupBy("cluster").agg(
        F.expr("sum(CAST(distance AS decimal(38, 0)))").alias("total"), F.count_if(F.col("distance").isNull()).alias("lost")
    )
    inertia = {r.cluster: None if r.lost else int(r.total) for r in found.collect()}
    whole_inertia = None if None in inertia.values() else sum(inertia.values())

    def by_cluster(texts: dict[int, str], kind: str) -> str:
        branches = " ".join(f"WHEN {c} THEN {t}" for c, t in texts.items())
        return f"CAST(CASE cluster {branches} END AS {kind})"

    def long(value: int | None) -> str:
        return "NULL" if value is None or value >= 1 << 63 else f"{value}L"

    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = placed.selectExpr(
        "row",
        "cluster",
        "distance",
        f"{by_cluster({c: long(t) for c, t in inertia.items()}, 'long')} AS cluster_inertia",
        f"CAST({long(whole_inertia)} AS long) AS inertia",
        f"{by_cluster({c: repr(h) for c, h in enumerate(hashes)}, 'string')} AS centroid_sha256",
    )
    return out, centroids
