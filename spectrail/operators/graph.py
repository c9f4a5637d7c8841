"""Similarity graphs of many points in blocks, and the leading eigenvectors of their normalised Laplacian.

Points are dealt into cells of a grid in the coordinates that spread most, as wide as the distance beyond which similarity
is below `least`; only blocks of neighbouring cells are compared, and what is compared is kept as sparse blocks of the
matrix. No row of the whole matrix, no vector of all points is ever in one place: vectors are rows of blocks, a product with
the matrix is a join with its blocks and a sum by block, and the driver sees matrices of the size of the basis only.

Eigenvectors come from a block Lanczos method with full orthogonalisation, whose blocks have as many columns as vectors are
asked for, so that repeated eigenvalues, as of a graph in several parts, are found as often as they occur.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import delete, discard, shared_dir, written
from .factorise import bucket_count
from .kernels import matrix, uniform_by_id
from .reshape import dense_sum

#: Points of a block, about.
BLOCK = 512
#: Metrics in which two points are at least as far apart as in any coordinate.
BY_COORDINATE = ("euclidean", "manhattan", "minkowski", "chebyshev")


def distances(metric: str, a: np.ndarray, b: np.ndarray, p: int = 3) -> np.ndarray:
    """Distances of all rows of a to all rows of b, as functions.vectors.distance() has them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "cosine":
            return 1 - a @ b.T / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        out = np.zeros((len(a), len(b)))
        if metric == "jaccard":
            low, high = out.copy(), out.copy()
            for x, y in zip(a.T, b.T, strict=True):
                low += np.minimum.outer(x, y)
                high += np.maximum.outer(x, y)
            return 1 - low / high
        for x, y in zip(a.T, b.T, strict=True):
            gap = np.abs(np.subtract.outer(x, y))
            if metric == "chebyshev":
                np.maximum(out, gap, out=out)
            elif metric == "hamming":
                out += gap != 0
            elif metric in ("euclidean", "manhattan", "minkowski"):
                out += gap ** {"euclidean": 2, "manhattan": 1, "minkowski": p}[metric]
            else:
                raise ValueError(f"unknown metric {metric}")
    return out ** {"euclidean": 0.5, "minkowski": 1 / p}.get(metric, 1)


def _flat(rows: list[np.ndarray], kind: pa.DataType = pa.float64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([r.size for r in rows])]), pa.int32()), pa.array(np.concatenate([r.ravel() for r in rows]) if rows else [], kind))


def dealt(points: DataFrame, metric: str, radius: float, block: int = BLOCK) -> DataFrame:
    """(block, c0, c1, ids, x): points(point_id, features) in blocks of about as many points; c0 and c1 are a block's cell."""
    own = points.select(F.col("point_id").cast("long").alias("point_id"), F.transform("features", lambda v: v.cast("double")).alias("x"))
    cells = [F.lit(0), F.lit(0)]
    if metric in BY_COORDINATE:
        ends = own.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.min("v").alias("low"), (F.max("v") - F.min("v")).alias("span")).orderBy(F.col("span").desc(), "i").limit(2).collect()
        cells = [F.floor((F.get("x", r["i"]) - r["low"]) / radius) if r["span"] > radius else F.lit(0) for r in ends]
        cells += [F.lit(0)] * (2 - len(cells))
    placed = own.select("point_id", "x", *(c.cast("long").alias(f"c{i}") for i, c in enumerate(cells)))
    parts = placed.groupBy("c0", "c1").agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
    joined = placed.join(parts, ["c0", "c1"]).select("c0", "c1", F.pmod(F.xxhash64("point_id"), F.col("_n")).alias("part"), "point_id", "x")

    def gather(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("point_id").to_numpy(), kind="stable")
        x = matrix(table.column("x").combine_chunks()).T[order]
        first = [table.column(c).slice(0, 1).combine_chunks() for c in ("c0", "c1")]
        return pa.Table.from_arrays([*first, _flat([table.column("point_id").to_numpy()[order]], pa.int64()), _flat([x])], ["c0", "c1", "ids", "x"])

    blocks = joined.groupBy("c0", "c1", "part").applyInArrow(gather, "c0 long, c1 long, ids array<long>, x array<double>")
    return blocks.select(F.monotonically_increasing_id().alias("block"), "c0", "c1", "ids", "x")


def similar_blocks(blocks: DataFrame, metric: str, sigma: float, p: int, least: float) -> DataFrame:
    """(a, b, n, i, j, s): the similarities of at least `least` of the points of block a (n in number) to those of block b, by
    place in the block."""
    beside = F.array(*(F.struct((F.col("c0") + d).alias("c0"), (F.col("c1") + e).alias("c1")) for d in (-1, 0, 1) for e in (-1, 0, 1)))
    left = blocks.select(F.col("block").alias("a"), F.col("x").alias("xa"), F.size("ids").alias("na"), F.explode(beside).alias("_c")).select("a", "xa", "na", F.col("_c.c0").alias("c0"), F.col("_c.c1").alias("c1"))
    right = blocks.select(F.col("block").alias("b"), F.col("x").alias("xb"), F.size("ids").alias("nb"), "c0", "c1")
    two = left.join(right, ["c0", "c1"]).where(F.col("a") <= F.col("b")).select("a", "b", "na", "nb", "xa", "xb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, na, nb = (batch.column(c)[k].as_py() for c in range(4))
                xa, xb = (batch.column(c)[k].values.to_numpy().reshape(n, -1) for c, n in ((4, na), (5, nb)))
                d = distances(metric, xa, xb, p)
                s = np.where(np.isnan(d), 0.0, np.exp(-(d * d) / (2 * sigma * sigma)))
                if a == b:
                    np.fill_diagonal(s, 1.0)
                i, j = np.nonzero(s >= least)
                found = [(a, b, na, i, j)] + ([(b, a, nb, j, i)] if a != b else [])
                if len(i):
                    yield pa.RecordBatch.from_arrays([*(pa.array([f[c] for f in found]) for c in range(3)), *(_flat([f[c].astype(np.int32) for f in found], pa.int32()) for c in (3, 4)), _flat([s[i, j]] * len(found))], ["a", "b", "n", "i", "j", "s"])

    return two.mapInArrow(compare, "a long, b long, n long, i array<int>, j array<int>, s array<double>")


def most_bytes(blocks: DataFrame) -> int:
    """How many bytes the similarities of all neighbouring blocks can take, from the blocks' sizes."""
    sizes = blocks.groupBy("c0", "c1").agg(F.sum(F.size("ids").cast("double")).alias("n"))
    beside = F.array(*(F.struct((F.col("c0") + d).alias("c0"), (F.col("c1") + e).alias("c1")) for d in (-1, 0, 1) for e in (-1, 0, 1)))
    near = sizes.select(F.col("n").alias("m"), F.explode(beside).alias("_c")).select("m", F.col("_c.c0").alias("c0"), F.col("_c.c1").alias("c1"))
    return int(16 * (near.join(sizes, ["c0", "c1"]).agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0))


class Graph:
    """A graph in blocks in the shared folder, in buckets by the block that a product reads. Deleted by close()."""

    def __init__(self, points: DataFrame, metric: str, sigma: float, p: int = 3, least: float = 1e-16, block: int = BLOCK) -> None:
        self.spark = points.sparkSession
        self.blocks = written(dealt(points, metric, sigma * np.sqrt(-2 * np.log(least)), block), "blocks")
        self.name = f"graph_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        n = bucket_count(most_bytes(self.blocks), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        if n > int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
            self.spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(n))
        found = similar_blocks(self.blocks, metric, sigma, p, least)
        found.repartition(n, "b").write.bucketBy(n, "b").format("parquet").option("path", self.path).saveAsTable(self.name)

    def times(self, vectors: DataFrame) -> DataFrame:
        """(block, y): the matrix times vectors (block, v), where v holds the rows of a block's points one after another."""

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: dict[int, np.ndarray] = {}
                for k in range(batch.num_rows):
                    a, n = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    i, j, s, v = (batch.column(c)[k].values.to_numpy() for c in range(2, 6))
                    v = v.reshape(batch.column(6)[k].as_py(), -1)
                    y = found.setdefault(a, np.zeros((n, v.shape[1])))
                    for c in range(v.shape[1]):
                        y[:, c] += np.bincount(i, s * v[j, c], n)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found)), _flat(list(found.values()))], ["block", "y"])

        joined = self.spark.table(self.name).join(vectors.select(F.col("block").alias("b"), "v", "n_v").hint("shuffle_hash"), "b")
        sums = joined.select("a", "n", "i", "j", "s", "v", "n_v").mapInArrow(product, "block long, y array<double>")
        return dense_sum(sums, "y", "block").withColumnRenamed("total", "y")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)
        discard(self.blocks)


STATE = "block long, ids array<long>, root array<double>, q array<double>"


def _over(state: DataFrame, f, schema: str) -> DataFrame:
    """f(ids, root, q, w) of each block gives values of schema's columns; w is what a product has found, if there is one."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, root, q, *w = (batch.column(c)[k].values.to_numpy() for c in range(1, batch.num_columns))
                found = f(ids, root, q.reshape(len(ids), -1), w[0].reshape(len(ids), -1) if w else None)
                lists = {"array<double>": pa.float64(), "array<long>": pa.int64()}
                kinds = [c.strip().split(" ")[1] for c in schema.split(",")]
                values = [batch.column(0).slice(k, 1) if v is None else _flat([np.asarray(v)], lists[kind]) for v, kind in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(values, names)

    return state.mapInArrow(run, schema)


def eigenvectors(graph: Graph, k: int, tol: float = 1e-10, steps: int = 60, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(point_id, features): the k eigenvectors of the normalised Laplacian with the smallest eigenvalues, in that order, and
    these. The largest value of each by size is positive. k at most the number of points."""
    start = graph.blocks.select("block", "ids", F.array().cast("array<double>").alias("root"), F.transform("ids", lambda i: F.lit(1.0)).alias("q"))
    total = graph.blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
    k = min(k, total)
    degrees = graph.times(start.select("block", F.col("q").alias("v"), F.size("ids").alias("n_v")))
    state = start.drop("root").join(degrees, "block").select("block", "ids", F.col("y").alias("root"), "q")
    state = _over(state, lambda ids, d, q, w: (None, ids, 1 / np.sqrt(d), 2 * uniform_by_id(ids, k, seed) - 1), STATE)
    state, basis = written(state, "basis"), 0
    widths: list[int] = []

    def added(rows: DataFrame, f, shape: tuple[int, int]) -> np.ndarray:
        return np.array(dense_sum(_over(rows, lambda *a: (f(*a),), "part array<double>"), "part").first()["total"]).reshape(shape)

    def orthonormal(g: np.ndarray) -> np.ndarray:
        """What takes columns with these products to orthonormal ones; columns that add nothing fall away."""
        vals, vecs = np.linalg.eigh(g)
        kept = vals > max(1e-24, 1e-20 * vals.max(initial=0.0))
        return vecs[:, kept] / np.sqrt(vals[kept])

    first = orthonormal(added(state, lambda ids, root, q, w: q.T @ q, (k, k)))
    fresh = written(_over(state, lambda ids, root, q, w: (None, ids, root, q @ first), STATE), "basis")
    discard(state)
    state, basis = fresh, first.shape[1]
    widths.append(basis)
    t = np.zeros((0, 0))
    for _ in range(steps):
        last = widths[-1]
        scaled = _over(state, lambda ids, root, q, w, last=last: (None, root[:, None] * q[:, -last:]), "block long, v array<double>").join(graph.blocks.select("block", F.size("ids").alias("n_v")), "block")
        both = state.join(graph.times(scaled), "block").persist(StorageLevel.MEMORY_AND_DISK)
        moved = lambda root, w: root[:, None] * w
        c = added(both, lambda ids, root, q, w: q.T @ moved(root, w), (basis, last))
        again = added(both, lambda ids, root, q, w, c=c: q.T @ (moved(root, w) - q @ c), (basis, last))
        left = lambda root, q, w, c=c, again=again: (moved(root, w) - q @ c) - q @ again
        g = added(both, lambda ids, root, q, w, left=left: left(root, q, w).T @ left(root, q, w), (last, last))
        whole = np.zeros((basis, basis))
        whole[: len(t), : len(t)] = t
        whole[:, -last:] = c + again
        whole[-last:, :] = whole[:, -last:].T
        t = (whole + whole.T) / 2
        vals, vecs = np.linalg.eigh(t)
        best = vecs[:, ::-1][:, :k]
        error = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", best[-last:], g, best[-last:]), 0))
        into = orthonormal(g)
        if basis >= total or not into.shape[1] or (basis >= k and error.max() < tol):
            both.unpersist()
            break
        fresh = written(_over(both, lambda ids, root, q, w, left=left, into=into: (None, ids, root, np.hstack([q, left(root, q, w) @ into])), STATE), "basis")
        both.unpersist()
        discard(state)
        state, basis = fresh, basis + into.shape[1]
        widths.append(into.shape[1])
    size = best.shape[1]
    peaks = _over(state, lambda ids, root, q, w: ((q @ best)[np.abs(q @ best).argmax(axis=0), np.arange(size)],), "part array<double>")
    by_size = peaks.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.max_by("v", F.abs("v")).alias("v")).orderBy("i").collect()
    signed = best * np.where([r["v"] < 0 for r in by_size], -1.0, 1.0)
    found = _over(state, lambda ids, root, q, w: (ids, q @ signed), "ids array<long>, f array<double>")
    rows = found.select(F.posexplode("ids").alias("_i", "point_id"), "f").select("point_id", F.slice("f", F.col("_i") * size + 1, F.lit(size)).alias("features"))
    result = written(rows, "eigenvectors")
    discard(state)
    return result, 1 - vals[::-1][:k]
