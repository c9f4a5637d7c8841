"""Clustering and unmixing of pooled components: points(point_id, features array<double>), a few for each block.

Points stay on the executors: what comes to the driver are centres, moments of the channels and the points that are chosen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..sources.shared import written
from .factorise import gram
from .graph import BLOCK, Graph, dealt, eigenvectors, similar_blocks
from .kernels import matrix, nnls
from .reshape import dense_sum


def similarity_graph(points: DataFrame, metric: str, sigma: float, p: int = 3, least: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(i, j, s) of the ordered pairs of points whose similarity is at least `least`, and s = 1 of each with itself. Points are
    compared in blocks of bounded size (graph.py), and blocks that are too far apart for `least` aren't."""
    radius = sigma * np.sqrt(-2 * np.log(least)) if least > 0 else np.inf
    blocks = written(dealt(points, metric, float(radius), block), "blocks")
    found = similar_blocks(blocks, metric, sigma, p, least)
    ids = lambda side: blocks.select(F.col("block").alias(side), F.col("ids").alias(f"_{side}"))
    pairs = found.join(ids("a"), "a").join(ids("b"), "b").select("_a", "_b", F.explode(F.arrays_zip("i", "j", "s")).alias("e"))
    return pairs.select(F.get("_a", F.col("e.i")).alias("i"), F.get("_b", F.col("e.j")).alias("j"), F.col("e.s").alias("s"))


def normalised_laplacian(graph: DataFrame) -> DataFrame:
    """(i, j, l): identity less s over the square roots of both degrees."""
    degree = graph.groupBy("i").agg(F.sum("s").alias("d"))
    joined = graph.join(degree, "i").join(degree.toDF("j", "e"), "j")
    same = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(0.0))
    return joined.select("i", "j", (same - F.col("s") / F.sqrt(F.col("d") * F.col("e"))).alias("l"))


def kmeans(data: np.ndarray, k: int, rounds: int, tol: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, centroids and distances: seeded k-means++ and Lloyd steps until both error and centroids settle."""
    rng = np.random.default_rng(seed)
    centres = [data[rng.integers(len(data))]]
    while len(centres) < k:
        d = np.min([((data - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(data[rng.choice(len(data), p=d / d.sum())] if d.sum() > 0 else data[rng.integers(len(data))])
    c, error = np.array(centres), np.inf
    for _ in range(rounds):
        d = np.sqrt(((data[:, None] - c[None]) ** 2).sum(axis=2))
        labels = d.argmin(axis=1)
        new = np.array([data[labels == i].mean(axis=0) if (labels == i).any() else c[i] for i in range(k)])
        now = d[np.arange(len(data)), labels].sum()
        done = abs(error - now) < tol and np.linalg.norm(new - c) < tol
        c, error = new, now
        if done:
            break
    d = np.sqrt(((data[:, None] - c[None]) ** 2).sum(axis=2))
    return d.argmin(axis=1), c, d.min(axis=1)


def _weighted_start(data: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """Centres of weighted points in memory: k-means++ and Lloyd steps."""
    centres = [data[rng.choice(len(data), p=weight / weight.sum())]]
    while len(centres) < k:
        d = np.min([((data - c) ** 2).sum(axis=1) for c in centres], axis=0) * weight
        centres.append(data[rng.choice(len(data), p=d / d.sum())] if d.sum() > 0 else data[rng.integers(len(data))])
    c = np.array(centres)
    for _ in range(rounds):
        labels = ((data[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([np.average(data[labels == i], axis=0, weights=weight[labels == i]) if (labels == i).any() else c[i] for i in range(k)])
        if np.array_equal(new, c):
            break
        c = new
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the columns of x to the rows of c."""
    return np.array([((x - row[:, None]) ** 2).sum(axis=0) for row in c])


def kmeans_start(points: DataFrame, k: int, seed: int, rounds: int = 5) -> np.ndarray:
    """Centres by k-means|| (Bahmani et al., 2012): in each round a point is taken with a chance in proportion to its squared
    distance, 2 k of them on the average; all that were taken are weighted by the points nearest to them and clustered."""
    spark, u = points.sparkSession, (F.pmod(F.xxhash64(F.lit(seed), F.col("_round"), "point_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    first = points.withColumn("_round", F.lit(-1)).select(F.min_by("features", F.struct(u, "point_id"))).first()[0]
    centres = np.array([first], float)

    def nearest(what: str):
        shared = spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = _squares(matrix(b.column(1)), shared.value)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d.min(axis=0)), pa.array(d.argmin(axis=0).astype(np.int32))], ["point_id", "d", "c"])

        return points.select("point_id", "features").mapInArrow(run, "point_id long, d double, c int").select(*what.split())

    for i in range(rounds):
        total = nearest("d").agg(F.sum("d")).first()[0]
        if not total:
            break
        taken = nearest("point_id d").withColumn("_round", F.lit(i)).where(u * total < 2.0 * k * F.col("d")).select("point_id")
        new = [r["features"] for r in points.join(taken, "point_id", "left_semi").orderBy("point_id").select("features").collect()]  # 2 k on the average
        if new:
            centres = np.vstack([centres, new])
    weight = np.zeros(len(centres))
    for r in nearest("c").groupBy("c").count().collect():
        weight[r["c"]] = r["count"]
    return _weighted_start(centres, weight, k, np.random.default_rng(seed))


def kmeans_points(points: DataFrame, k: int, rounds: int, tol: float, seed: int) -> tuple[DataFrame, np.ndarray]:
    """(point_id, cluster, distance) and the centres: Lloyd steps over partial sums from kmeans_start(), until both error and
    centres settle, as kmeans() does in memory. A cluster without points keeps its centre."""
    points = points.select(F.col("point_id").cast("long").alias("point_id"), "features").persist(StorageLevel.MEMORY_AND_DISK)
    c, error = kmeans_start(points, k, seed), np.inf
    for _ in range(rounds):
        shared = points.sparkSession.sparkContext.broadcast(c)

        def part(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(0))
                    d = _squares(x, shared.value)
                    hot = np.zeros(d.shape)
                    hot[d.argmin(axis=0), np.arange(x.shape[1])] = 1.0
                    sums = np.concatenate([hot.sum(axis=1), (hot @ x.T).ravel(), [np.sqrt(d.min(axis=0)).sum()]])
                    yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["part"])

        found = np.array(dense_sum(points.select("features").mapInArrow(part, "part array<double>"), "part").first()["total"])
        n, sums, now = found[:k], found[k:-1].reshape(k, -1), found[-1]
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        done = abs(error - now) < tol and np.linalg.norm(new - c) < tol
        c, error = new, now
        if done:
            break
    points.unpersist()
    found = nearest_centre(points, c.tolist())
    return found.select("point_id", "cluster", "distance"), c


def spectral_clusters(points: DataFrame, k: int, sigma: float, metric: str = "manhattan", p: int = 3, rounds: int = 100, tol: float = 1e-10, seed: int = 0, least: float = 1e-16) -> DataFrame:
    """(point_id, cluster, distance): k-means of the Laplacian's first k eigenvectors. Similarities below `least` count as 0,
    so what is far apart is neither compared nor kept (graph.py)."""
    graph = Graph(points, metric, sigma, p, least)
    try:
        vectors = eigenvectors(graph, k, seed=seed)[0]
    finally:
        graph.close()
    return kmeans_points(vectors, k, rounds, tol, seed)[0]


def ranked_members(clusters: DataFrame) -> DataFrame:
    """(cluster, rank, point_id): a row for each member, ranked from 0 by distance, then id."""
    return clusters.select("cluster", (F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "point_id")) - 1).alias("rank"), "point_id")


def members_by_distance(clusters: DataFrame) -> DataFrame:
    """(cluster, members): ids in order of distance, then id."""
    ordered = F.array_sort(F.collect_list(F.struct("distance", "point_id")))
    return clusters.groupBy("cluster").agg(F.transform(ordered, lambda m: m["point_id"]).alias("members"))


def nearest_centre(points: DataFrame, centres: Sequence[Sequence[float]], metric: str = "euclidean") -> DataFrame:
    """Add cluster and distance of the closest centre, the first of equals."""
    d = F.array(*(V.distance(metric, F.col("features"), V.literal(c)) for c in centres))
    return points.withColumns({"cluster": V.argmin(d).cast("int"), "distance": F.array_min(d)})


def clustered_w(points: DataFrame, clusters: DataFrame, features: str = "features") -> DataFrame:
    """(cluster, w): the mean of each cluster's members; a cluster without members has no row."""
    long = points.join(clusters.select("point_id", "cluster"), "point_id").select("cluster", F.posexplode(features).alias("row", "v"))
    mean = long.groupBy("cluster", "row").agg(F.avg("v").alias("v"))
    return mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda x: x["v"]).alias("w"))


def presences(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """(block_id, cluster) of the clusters that a block has a component in."""
    return points.join(clusters.select("point_id", "cluster"), "point_id").select("block_id", "cluster").distinct()


def snr(r: np.ndarray, mean: np.ndarray, x: np.ndarray) -> float:
    """Signal to noise in dB, of data (channels x points), its mean and its projection."""
    whole, kept = (r * r).sum() / r.shape[1], (x * x).sum() / r.shape[1] + mean @ mean
    return float("inf") if whole <= kept else float(10 * np.log10(max((kept - len(x) / len(r) * whole) / (whole - kept), 1e-300)))


def _axes(moments: np.ndarray, p: int) -> np.ndarray:
    """The leading axes of second moments, each with its largest value positive."""
    u = np.linalg.svd(moments)[0][:, :p]
    return u * np.where(u[np.abs(u).argmax(axis=0), np.arange(p)] < 0, -1, 1)


def vca(r: np.ndarray, p: int, seed: int = 0) -> tuple[list[int], np.ndarray]:
    """Vertex component analysis (Nascimento and Dias, 2005): p points of r (channels x points), and the projected data
    there. Points that agree in four significant digits count once; ties go to the later point."""
    if not 0 < p <= len(r):
        raise ValueError("the number of endmembers must be from 1 to the number of rows")
    mean = r.mean(axis=1)
    centred = r - mean[:, None]
    u = _axes(centred @ centred.T / r.shape[1], p)
    x = u.T @ centred
    if snr(r, mean, x) < 15 + 10 * np.log10(p):
        u, x = u[:, : p - 1], x[: p - 1]
        projected = u @ x + mean[:, None]
        y = np.vstack([x, np.full(r.shape[1], np.sqrt((x * x).sum(axis=0).max(initial=0.0)))])
    else:
        u = _axes(r @ r.T / r.shape[1], p)
        x = u.T @ r
        projected, along = u @ x, x.mean(axis=1) @ x
        y = x / np.where(along == 0, 1.0, along)
    rng, found, seen = np.random.default_rng(seed), [], set()
    a = np.zeros((p, p))
    a[-1, 0] = 1.0
    for i in range(p):
        w = rng.standard_normal(p)
        f = w - a @ (np.linalg.pinv(a) @ w)
        size = np.abs(f @ y) / max(np.linalg.norm(f), 1e-300)
        for j in sorted(range(len(size)), key=lambda k: (size[k], k), reverse=True):
            text = " ".join(f"{v:.4g}" for v in projected[:, j])
            if j not in found and text not in seen:
                break
        else:
            raise ValueError("fewer different points than endmembers")
        seen.add(text)
        found.append(j)
        a[:, i] = y[:, j]
    return found, projected[:, found]


def vca_points(points: DataFrame, p: int, seed: int = 0, features: str = "features") -> tuple[list[int], np.ndarray]:
    """vca() of points that stay on the executors: ids of p points, and the projected data there (rows x p).

    Moments and the mean are sums over tasks, each extreme is one aggregate, and points that look like a chosen one in four
    significant digits are left out of the next. Later points, by id, win ties.
    """
    spark = points.sparkSession
    data = points.select(F.col("point_id").cast("long").alias("point_id"), F.col(features).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    rows, n = data.select(F.max(F.size("x")), F.count(F.lit(1))).first()
    if not n or not 0 < p <= rows:
        raise ValueError("the number of endmembers must be from 1 to the number of rows")
    mean = np.array(dense_sum(data, "x").first()["total"]) / n
    around = gram(data.select(F.zip_with("x", V.literal(mean.tolist()), lambda a, b: a - b).alias("x")), "x") / n
    u, whole = _axes(around, p), float(np.trace(around) + mean @ mean)
    kept = float(np.trace(u.T @ around @ u) + mean @ mean)
    ratio = float("inf") if whole <= kept else 10 * np.log10(max((kept - p / rows * whole) / (whole - kept), 1e-300))
    low = ratio < 15 + 10 * np.log10(p)
    if low:
        u = u[:, : p - 1]
    else:
        u = _axes(around + np.outer(mean, mean), p)
        toward = u.T @ mean

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = u.T @ (matrix(b.column(1)) - (mean[:, None] if low else 0))
                projected = u @ x + (mean[:, None] if low else 0)
                along = np.ones(x.shape[1]) if low else toward @ x
                y = x / np.where(along == 0, 1.0, along)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(m.shape[1] + 1) * m.shape[0], pa.int32()), pa.array(np.ascontiguousarray(m.T).ravel())) for m in (y, projected)]
                text = [" ".join(f"{v:.4g}" for v in column) for column in projected.T]
                yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array(text)], ["point_id", "y", "projected", "text"])

    own = data.mapInArrow(project, "point_id long, y array<double>, projected array<double>, text string").persist(StorageLevel.MEMORY_AND_DISK)
    if low:
        longest = own.agg(F.max(V.total(F.transform("y", lambda v: v * v)))).first()[0] or 0.0
        last = float(np.sqrt(longest))
    rng, found, seen = np.random.default_rng(seed), [], []
    a = np.zeros((p, p))
    a[-1, 0] = 1.0
    for i in range(p):
        w = rng.standard_normal(p)
        f = w - a @ (np.linalg.pinv(a) @ w)
        f = f / max(np.linalg.norm(f), 1e-300)
        y = F.concat("y", F.array(F.lit(last))) if low else F.col("y")
        size = F.abs(V.total(F.zip_with(y, V.literal(f.tolist()), lambda v, g: v * g)))
        free = own.where(~F.col("text").isin(seen)) if seen else own
        best = free.agg(F.max_by(F.struct("point_id", "projected", "text", y.alias("y")), F.struct(size, "point_id"))).first()[0]
        if best is None:
            raise ValueError("fewer different points than endmembers")
        seen.append(best["text"])
        found.append((best["point_id"], best["projected"]))
        a[:, i] = best["y"]
    own.unpersist()
    data.unpersist()
    return [i for i, _ in found], np.array([v for _, v in found]).T


def abundances_nnls(points: DataFrame, endmembers: np.ndarray, features: str = "features") -> DataFrame:
    """points with a: non-negative shares of the endmembers (rows x endmembers), at least 1e-10."""
    shared = points.sparkSession.sparkContext.broadcast(np.asarray(endmembers))

    def solve(column: pd.Series) -> pd.Series:
        """What least squares give without a bound where that is positive, for all rows at once; else by active sets."""
        ends, v = shared.value, np.array(column.tolist(), float).reshape(len(column), -1).T
        free = np.linalg.lstsq(ends, v, rcond=None)[0] if len(column) else np.zeros((ends.shape[1], 0))
        for k in np.flatnonzero((free < 0).any(axis=0)):
            free[:, k] = nnls(ends, v[:, k])
        return pd.Series(list(np.maximum(free, 1e-10).T))

    return points.withColumn("a", F.pandas_udf(solve, "array<double>")(F.col(features)))


def dominant(a: np.ndarray, blocks: Sequence[int]) -> dict[int, list[int]]:
    """Endmembers present in each block: of each component in turn the largest, or the largest that the block has not had."""
    found: dict[int, list[int]] = {}
    for row, block in zip(a, blocks, strict=True):
        had = found.setdefault(int(block), [])
        ranked = sorted(range(len(row)), key=lambda j: (row[j], j), reverse=True)
        first = int(np.argmax(row))
        free = [j for j in ranked if j not in had]
        had.append(first if first not in had or not free else free[0])
    return {b: sorted(set(v)) for b, v in found.items()}


def dominant_by_block(points: DataFrame, endmembers: np.ndarray, features: str = "features") -> DataFrame:
    """(block_id, present): dominant() of each block, from points(block_id, point_id, features); a block's components, in
    order of id, are one group."""
    rows = abundances_nnls(points.select("block_id", "point_id", features), endmembers, features).select("block_id", "point_id", "a")

    def choose(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("point_id")
        (found,) = dominant(np.array(own["a"].tolist()), [0] * len(own)).values()
        return pd.DataFrame({"block_id": [int(key[0])], "present": [found]})

    return rows.groupBy("block_id").applyInPandas(choose, "block_id int, present array<int>")
