"""Centroid clustering of vectors of whole numbers, exact, with an annulus search for the nearest centroid.

Centroids are kept in order of their norm. By the triangle inequality a centroid nearer to x than u has a norm within u
of that of x, so with u the distance of x to the centroid it had before (the centroid of the closest norm at first) only
those in that annulus, found by binary search, are compared; bounds are widened by more than what rounding can move, so
that centroids on the edge, which can be as near, are among them. Comparison is in whole numbers: the smaller number wins.

A round is one narrow pass over the vectors; each task adds up its vectors by centroid, so that sums of centroids are all
that is shuffled, however many vectors one centroid has. Centroids, as many numbers as clusters times components, and
their sums are what the driver and all tasks hold.

Defined cases: vectors with a null, NaN or infinite component, of another size, or null themselves are left out; a null
id is never a start unless ids run out; repeated rows count each, and repeated starts leave the later one empty, where it
stays; with fewer vectors than clusters there are as many clusters as vectors; components are cut to 27 bits on either
side, so that distances fit a long; a sum of distances beyond a long is null; an empty table gives an empty result; other
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, flat_list, materialize, released

#: Components are cut to this on either side; squared distances of so many components fit a long.
MOST, SIZE = 1 << 27, 127


def whole_vectors(rows: DataFrame, size: int, scale: int, key: str, vector: str) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors that count."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = lambda x: F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), F.lit(float(-MOST))), F.lit(float(MOST)))
    return rows.where(fine).select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(scaled(x)).cast("int")).alias("v"))


class Annulus:
    """Nearest of centroids (rows of whole numbers)."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.all = centroids
        self.norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.lexsort((np.arange(len(centroids)), self.norms))
        self.sorted = self.norms[self.order]

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared distances of the rows of x to those of y, or to y if it is one."""
        gap = x - y
        return np.einsum("...i,...i->...", gap, gap)

    def nearest(self, x: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of whole numbers the number of its centroid, the squared distance, and how many were compared."""
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        if before is None:
            i = np.clip(np.searchsorted(self.sorted, norms), 1, len(self.sorted) - 1) if len(self.sorted) > 1 else np.zeros(len(x), int)
            i = np.where((i > 0) & (np.abs(norms - self.sorted[i - 1]) <= np.abs(self.sorted[i] - norms)), i - 1, i)
            before = self.order[i]
        best, least = before.astype(np.int64), self.distances(x, self.all[before])
        wide = np.sqrt(least.astype(np.float64)) * (1 + 1e-9) + 1e-6 * (1 + norms * 1e-3)
        low, high = np.searchsorted(self.sorted, norms - wide, "left"), np.searchsorted(self.sorted, norms + wide, "right")
        compared = 0
        for place, number in enumerate(self.order):
            own = np.flatnonzero((low <= place) & (place < high))
            compared += len(own)
            if len(own):
                d = self.distances(x[own], self.all[number])
                nearer = (d < least[own]) | ((d == least[own]) & (number < best[own]))
                best[own[nearer]], least[own[nearer]] = number, d[nearer]
        return best, least, compared


def _pass(state: DataFrame, centroids: np.ndarray, first: bool) -> DataFrame:
    """(vec_id, v, cluster, distance) of each vector, and rows of sums without v: cluster, distance in sum, n, total."""
    shared, k = state.sparkSession.sparkContext.broadcast(centroids), len(centroids)

    @released
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Annulus(shared.value), np.zeros(k, np.int64)
        total, inertia = np.zeros((k, shared.value.shape[1]), np.int64), [0] * k
        names = ["vec_id", "v", "cluster", "distance", "n", "total", "inertia"]
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)
            best, least, _ = own.nearest(x, None if first else b.column(2).to_numpy())
            order = np.argsort(best, kind="stable")
            found, begin = np.unique(best[order], return_index=True)
            total[found] += np.add.reduceat(x[order], begin, axis=0)
            n += np.bincount(best, minlength=k)
            for c, part in zip(found, np.split(least[order], begin[1:]), strict=True):
                inertia[c] += int(part.astype(object).sum()) if len(part) and int(part.max()) > (1 << 62) // len(part) else int(part.sum())
            none = lambda kind, rows=b.num_rows: pa.nulls(rows, kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int32()), pa.array(least), none(pa.int64()), none(pa.list_(pa.int64())), none(pa.string())], names)
        kept = np.flatnonzero(n)
        sums = flat_list(total[kept].ravel(), np.arange(len(kept) + 1) * total.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.list_(pa.int32())), pa.array(kept, pa.int32()), pa.nulls(len(kept), pa.int64()), pa.array(n[kept]), sums, pa.array([str(inertia[c]) for c in kept], pa.string())], names)

    return state.select("vec_id", "v", *(() if first else ("cluster",))).mapInArrow(step, "vec_id long, v array<int>, cluster int, distance long, n long, total array<long>, inertia string")


def _sums(found: DataFrame) -> tuple[dict[int, tuple[int, list[int]]], dict[int, int]]:
    """n and total of each cluster with vectors, and its sum of distances, exact."""
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    parts = found.where("n is not null")
    sizes = {r["cluster"]: (int(r["n"]), int(r["d"])) for r in parts.groupBy("cluster").agg(whole("n").alias("n"), whole("inertia").alias("d")).collect()}
    cells = parts.select("cluster", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(whole("x").alias("x")).collect()
    totals: dict[int, dict[int, int]] = {}
    for r in cells:  # clusters times components
        totals.setdefault(r["cluster"], {})[r["i"]] = int(r["x"])
    return {c: (n, [totals[c][i] for i in range(len(totals[c]))]) for c, (n, _) in sizes.items()}, {c: d for c, (_, d) in sizes.items()}


def cluster(rows: DataFrame, clusters: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2, key: str = "vec_id", vector: str = "embedding", cut_every: int = 10) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that counts."""
    if size > SIZE:
        raise ValueError(f"vectors of {SIZE} components at most")
    spark = rows.sparkSession
    state = cut = materialize(whole_vectors(rows, size, scale, key, vector), "vectors")
    digest = F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    starts = state.select(digest.alias("_d"), "v").orderBy(F.col("_d").asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in starts], np.int64).reshape(len(starts), size)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        discard(cut)
        return spark.createDataFrame([], schema)
    held = []
    for i in range(rounds):
        found = _pass(state, centroids, i == 0)
        if (i + 1) % cut_every == 0:  # a lost executor costs the rounds since then
            found = materialize(found, "vectors")
        else:
            held.append(found.persist(StorageLevel.MEMORY_AND_DISK))
        sums, _ = _sums(found)
        for old in held[: -1 if (i + 1) % cut_every else None]:
            old.unpersist()
        if (i + 1) % cut_every == 0:
            discard(cut)
            cut, held = found, []
        state = found.where("n is null")
        for c, (n, total) in sums.items():
            centroids[c] = [x // n for x in total]
    last = materialize(_pass(state, centroids, not rounds), "clustered")
    for old in held:
        old.unpersist()
    discard(cut)
    _, inertia = _sums(last)
    fits = lambda x: x if x < 1 << 63 else None
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(c, fits(d), fits(sum(inertia.values())), shas[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row for each cluster
    return last.where("n is null").select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select(*(x.split(" ")[0] for x in schema.split(", ")))
