"""Factorisation of a table of pixels: all pixels together, or block by block.

Together: spectra are written once, in buckets by pixel, and are only read from then on. An iteration reads them once:
each task joins them with the pixels' h, which is the small side and all that is shuffled, updates h, and adds up the few
sums that the step of W needs. h alone is kept on the executors between passes, and is written to the shared folder every
few passes. W and the sums are the size of the dictionary and are all the driver sees.

Block by block: a group is a block, and a fit of a block is one kernel call.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Algorithm, Fit, Init
from ..functions import vectors as V
from ..sources.shared import delete, discard, shared_dir, written
from . import kernels as K
from .filters import above_floor
from .measures import normalisation_factor
from .reshape import dense_sum


_matrix = K.matrix


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(m.shape[1] + 1) * m.shape[0], pa.int32()), pa.array(np.ascontiguousarray(m.T).ravel()))


def solve_fixed(pixels: DataFrame, d: np.ndarray, simplex: bool = False, floor: float = 1e-14, x: str = "spectrum", out: str = "h") -> DataFrame:
    """(pixel_id, h): the magnitude of the least-squares abundances for a known D. Narrow: the small pseudo-inverse goes
    to each task; the same plan serves blocks and the whole image."""
    shared = pixels.sparkSession.sparkContext.broadcast(np.linalg.pinv(d))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            if b.num_rows:
                h = np.abs(p @ _matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(np.maximum(K.on_simplex(h) if simplex else h, floor))], ["pixel_id", out])

    return pixels.select(F.col("pixel_id").cast("long"), x).mapInArrow(solve, f"pixel_id long, {out} array<double>")


def gram(pixels: DataFrame, x: str = "spectrum") -> np.ndarray:
    """X X' (channels x channels): a partial product of each task, added up in a tree of reducers by channel."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                total = total + m @ m.T
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), _lists(total)], ["i", "row"])

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = pixels.select(x).mapInArrow(part, "i int, row array<double>").select("i", array_to_vector("row").alias("v"))
    found = rows.groupBy("i").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("row")).orderBy("i").collect()
    return np.array([r["row"] for r in found])


def svd_start(pixels: DataFrame, fit: Fit, x: str = "spectrum") -> tuple[np.ndarray, np.ndarray, float]:
    """D of a start from the leading vectors of the channels' Gram matrix, the matrix that takes spectra to the start's H
    before values below 0 are cut, and the mean of X. Each component's side is that where |u| |v| is larger; the norms of
    v's sides are added up over the pixels, in one narrow pass."""
    vals, vecs = np.linalg.eigh(gram(pixels, x))
    vals, u = vals[::-1][: fit.components], vecs[:, ::-1][:, : fit.components]
    s = np.sqrt(np.where(vals > max(vals[0], 0) * len(vecs) * np.finfo(float).eps, vals, 0))
    to_v = np.divide(u.T, s[:, None], out=np.zeros_like(u.T), where=s[:, None] > 0)
    shared = pixels.sparkSession.sparkContext.broadcast(to_v)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                v = shared.value @ m
                sums = [*(np.maximum(v, 0) ** 2).sum(axis=1), *(np.maximum(-v, 0) ** 2).sum(axis=1), m.sum(), m.size]
                yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["part"])

    *squares, total, size = dense_sum(pixels.select(x).mapInArrow(part, "part array<double>"), "part").first()["total"]
    v_sides = np.sqrt(np.reshape(squares, (2, -1)))
    u_sides = np.array([np.linalg.norm(np.maximum(sign * u, 0), axis=0) for sign in (1, -1)])
    best = np.where(u_sides[0] * v_sides[0] > u_sides[1] * v_sides[1], 0, 1)
    every = np.arange(len(s))
    na, nb = u_sides[best, every], v_sides[best, every]
    by = np.sqrt(np.divide(s * na, nb, out=np.zeros_like(s), where=nb > 0)) * np.array([1, -1])[best]
    by[0] = np.sqrt(s[0])
    # a pair of pixels with v's norms stands for all pixels
    d, _ = K.from_svd(u, s, np.array([v_sides[0], -v_sides[1]]).T, Init(fit.init), fit.eps, total / size, np.random.default_rng(fit.seed))
    return d, by[:, None] * to_v, total / size


def nndsvd_start(pixels: DataFrame, g: np.ndarray, fit: Fit, x: str = "spectrum") -> np.ndarray:
    """W from svd_start()."""
    return np.maximum(K.start_w(svd_start(pixels, fit, x)[0], g, fit), fit.floor)


def start(pixels: DataFrame, g: np.ndarray, fit: Fit, w: np.ndarray | None, h: DataFrame | None, x: str = "spectrum") -> tuple[np.ndarray, DataFrame]:
    """W and (pixel_id, h) to begin with; each may be given. H of NNDSVD follows from W by least squares, H of the other
    starts is theirs. Random values are of the seed and the pixel, however pixels are dealt out."""
    init = Init(fit.init)
    if h is not None:
        given = F.transform("h", lambda v: above_floor(v, fit.floor)) if fit.safe else F.col("h")
        h = h.select(F.col("pixel_id").cast("long").alias("pixel_id"), V.clip_below(given, fit.floor).alias("h"))
        if w is None:
            both = pixels.join(h, "pixel_id").select(x, "h")

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        m, hh = _matrix(b.column(0)), _matrix(b.column(1))
                        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([(m @ hh.T).ravel(), (hh @ hh.T).ravel()]).tolist()], pa.list_(pa.float64()))], ["part"])

            found = np.array(dense_sum(both.mapInArrow(sums, "part array<double>"), "part").first()["total"])
            xh, hh = found[: g.shape[0] * fit.components].reshape(g.shape[0], -1), found[g.shape[0] * fit.components :].reshape(fit.components, -1)
            w = K.start_w(np.abs(xh @ np.linalg.pinv(hh)), g, fit)
        return np.maximum(w, fit.floor), h
    if w is not None or init == Init.NNDSVD:
        w = nndsvd_start(pixels, g, fit, x) if w is None else np.maximum(w, fit.floor)
        return w, solve_fixed(pixels, g @ w, fit.simplex_h, fit.floor, x)
    if init == Init.RANDOM:
        mean = pixels.agg(F.sum(V.total(F.col(x))) / F.sum(F.size(x))).first()[0]
        d, to_h = np.abs(np.random.default_rng(fit.seed).standard_normal((g.shape[0], fit.components))) * np.sqrt(mean), None
    else:
        d, to_h, mean = svd_start(pixels, fit, x)
    shared = pixels.sparkSession.sparkContext.broadcast(to_h)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                if init != Init.NNDSVDA:
                    noise = np.abs(K.normal_by_id(b.column(0).to_numpy(), d.shape[1], fit.seed)).T
                if init == Init.RANDOM:
                    values = noise * np.sqrt(mean)
                else:
                    values = shared.value @ _matrix(b.column(1))
                    values[0] = np.abs(values[0])
                    values = np.where(values < fit.eps, mean if init == Init.NNDSVDA else np.abs(mean) * noise / 100, values)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(np.maximum(K.on_simplex(values) if fit.simplex_h else values, fit.floor))], ["pixel_id", "h"])

    return np.maximum(K.start_w(d, g, fit), fit.floor), pixels.select(F.col("pixel_id").cast("long"), x).mapInArrow(first, "pixel_id long, h array<double>")


def without_empty(pixels: DataFrame, floor: float, x: str = "spectrum") -> DataFrame:
    """All values of pixels and of channels whose sum is 0 become the floor."""
    least = F.lit(float(floor))
    full = F.zip_with(x, "_c", lambda v, c: F.when(c == 0, least).otherwise(v))
    filled = F.when(V.total(F.col(x)) == 0, F.transform(x, lambda v: least)).otherwise(full)
    return pixels.join(F.broadcast(dense_sum(pixels, x).withColumnRenamed("total", "_c"))).withColumn(x, filled).drop("_c")


#: Bytes of spectra in a bucket, at most; and at least, where more buckets would only give more tasks.
BUCKET_BYTES, LEAST_BYTES = 128 << 20, 1 << 20


def bucket_count(size: int, tasks: int) -> int:
    """Buckets for so many bytes: as many as the tasks that run at once while buckets stay over LEAST_BYTES, and more when
    they would go over BUCKET_BYTES, whatever the size of the table."""
    return max(1, -(-size // BUCKET_BYTES), min(tasks, size // LEAST_BYTES))


class Spectra:
    """Spectra in buckets by pixel, in the shared folder, so that joins with them by pixel move the other side only. Deleted
    by close()."""

    def __init__(self, pixels: DataFrame, x: str, factor: float = 1.0, fixed_h: DataFrame | None = None) -> None:
        self.spark = pixels.sparkSession
        self.name = f"spectra_{uuid.uuid4().hex}"
        size = pixels.agg(F.coalesce(F.sum(F.size(x).cast("long")), F.lit(0))).first()[0] * 8
        self.buckets = bucket_count(size, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        if self.buckets > int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
            self.spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(self.buckets))
        own = pixels.select(F.col("pixel_id").cast("long").alias("pixel_id"), (F.col(x) if factor == 1.0 else V.scale(F.col(x), factor)).alias("x"))
        self.columns = ["x"] if fixed_h is None else ["x", "fixed"]
        if fixed_h is not None:
            fixed = fixed_h.select(F.col("pixel_id").cast("long").alias("pixel_id"), F.transform("h", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("_fixed"))
            width = fixed.agg(F.max(F.size("_fixed"))).first()[0] or 1
            own = own.join(fixed, "pixel_id", "left").select("pixel_id", "x", F.coalesce("_fixed", F.array_repeat(F.lit(float("nan")), width)).alias("fixed"))
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        own.repartition(self.buckets, "pixel_id").write.bucketBy(self.buckets, "pixel_id").format("parquet").option("path", self.path).saveAsTable(self.name)

    def with_h(self, h: DataFrame) -> DataFrame:
        """(pixel_id, x, h), and the fixed values of h if there are any"""
        return self.spark.table(self.name).join(h.select("pixel_id", "h").hint("shuffle_hash"), "pixel_id").select("pixel_id", "x", "h", *self.columns[1:])

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def _pass(spectra: Spectra, h: DataFrame, d: np.ndarray, top: np.ndarray | None, fit: Fit, sigma: float | None = None, gamma: float | None = None, move: bool = True) -> DataFrame:
    """(pixel_id, h, was, part): h after a step and before it, and in the first row of each batch what its pixels add: to the
    loss before the step, the sum of X, its size and the change of h; to the search for the next step's length, if there is
    one; and to the step of W. gamma: the step's inverse length, for projected gradients. Without move only the first three."""
    held = spectra.spark.sparkContext.broadcast((d, top))
    gradient = fit.algorithm == Algorithm.PROJECTED_GRADIENT

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dd, tt = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x, old = _matrix(b.column(1)), _matrix(b.column(2))
            fixed = _matrix(b.column(3)) if b.num_columns > 3 else None
            parts, new, search = [[K.loss(x, dd, old, fit), x.sum(), x.size]], old, []
            if move:
                if gradient:
                    grad = K.grad_h(x, dd, old, fit)
                    new = K.step_h(old, grad, gamma, fit, fixed)
                    gap = new - old
                    search = [K.loss(x, dd, new, fit), (gap * grad).sum(), (gap * gap).sum()] if fit.line_search else []
                else:
                    new = K.update_h(x, dd, old, fit, fixed, tt, sigma)
                    search = [*(old * np.log(old / new) - old + new).sum(axis=1), (old * new).sum(), (old * old).sum(), (new * new).sum()] if fit.line_search and fit.ridge else []
                parts += [[np.abs(new - old).sum()], search, *map(np.ravel, K.w_sums(x, dd, new, fit))]
            part = pa.array([np.concatenate(parts).tolist(), *[None] * (b.num_rows - 1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(new), _lists(old), part], ["pixel_id", "h", "was", "part"])

    return spectra.with_h(h).mapInArrow(step, "pixel_id long, h array<double>, was array<double>, part array<double>")


def _added(done: DataFrame) -> np.ndarray:
    return np.array(dense_sum(done.where("part is not null"), "part").first()["total"])


def _tops(h: DataFrame) -> np.ndarray:
    """The largest value of each component."""
    rows = h.select(F.posexplode("h").alias("c", "v")).groupBy("c").agg(F.max("v").alias("v")).orderBy("c").collect()
    return np.array([r["v"] for r in rows])


def change_of_h(done: DataFrame, mean: float, tol: float) -> float:
    """The largest |dh| / (h + tol mean |dh|): one narrow aggregate over rows that hold h before and after."""
    each = F.zip_with("h", "was", lambda new, old: F.abs(new - old) / (new + F.lit(tol * mean)))
    return float(done.agg(F.max(F.array_max(each))).first()[0])


def first_steps(spectra: Spectra, g: np.ndarray, k: int, fit: Fit) -> tuple[float, float]:
    """The inverse lengths of the first steps of H and W by projected gradients: kernels.lipschitz_h() and lipschitz_w() over
    all pixels, from one narrow pass with the sum of each channel and the largest weighted sum of a pixel."""
    row = g.sum(axis=1) * fit.floor
    weight = k * row * row / np.maximum((row * fit.floor * k) ** 2, 1e-300)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([float((weight @ x).max())]), pa.array([x.sum(axis=1).tolist()], pa.list_(pa.float64()))], ["most", "part"])

    found = spectra.spark.table(spectra.name).select("x").mapInArrow(part, "most double, part array<double>").persist(StorageLevel.MEMORY_AND_DISK)
    most, sums = found.agg(F.max("most")).first()[0], np.array(dense_sum(found, "part").first()["total"])
    found.unpersist()
    return float(most + 2 * fit.ridge + fit.mu * fit.mu_eps), K.lipschitz_w(sums[:, None], g, k, fit.floor)


def penalties(h: DataFrame, fit: Fit) -> float:
    """What the penalties add to the loss of all pixels."""
    each = F.aggregate("h", F.lit(0.0), lambda s, v: s + fit.mu * F.ln(v + fit.mu_eps) + 0.5 * fit.ridge * v * v)
    return float(h.agg(F.coalesce(F.sum(each), F.lit(0.0))).first()[0]) if fit.mu or fit.ridge else 0.0


def fit_pixels(pixels: DataFrame, g: np.ndarray, fit: Fit, w: np.ndarray | None = None, fixed_w: np.ndarray | None = None, update_w: bool = True, cut_every: int = 10, x: str = "spectrum", h: DataFrame | None = None, fixed_h: DataFrame | None = None, refresh: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, DataFrame, dict]:
    """W, (pixel_id, h) and a report of a fit over all pixels. With update_w=False only H moves.

    h: a start (pixel_id, h) for all pixels. fixed_h: (pixel_id, h), where null and NaN are free, as are missing pixels.
    refresh: what G becomes after each step of W; the last one is in the report.

    The loss after both steps of a round is known when the next round reads the spectra, so a round that proves to be one too
    many is left away, and the rounds, the reason for the stop and the loss are those of kernels.factorise().
    """
    if fit.safe:
        pixels = without_empty(pixels, fit.floor, x)
    began = time.perf_counter()
    factor = (normalisation_factor(pixels, fit.components, x).first()["factor"] or 1.0) if fit.normalise else 1.0
    spectra = Spectra(pixels, x, factor, fixed_h)
    gradient = fit.algorithm == Algorithm.PROJECTED_GRADIENT
    try:
        w, h = start(pixels.sparkSession.table(spectra.name), g, fit, w, h, "x")
        h = cut = written(h, "start")
        steps = list(first_steps(spectra, g, w.shape[1], fit)) if gradient else [fit.sigma, 0.0]
        ridge = bool(fit.ridge) and not gradient
        top = _tops(h) if ridge else None
        trace, before, why, initial, bound = [], np.inf, "max_iter", None, None
        change_w = change_h = np.inf
        for k in range(fit.max_iter + 1):
            settled = not fit.no_stop and max(change_w, change_h) < fit.tol
            move = k < fit.max_iter and not settled
            done = _pass(spectra, h, g @ w, top, fit, None if gradient else steps[0], steps[0] if gradient else None, move)
            cuts = move and (k + 1) % cut_every == 0
            done = written(done, "pass") if cuts else done.persist(StorageLevel.MEMORY_AND_DISK) if move else done
            s = _added(done)
            (value, total, size), s = s[:3], s[3:]
            now = value / size
            if k == 0:
                initial = now
            else:
                trace.append(float(now))
                if fit.verbose and k % 10 == 1:
                    print(f"round {k}: loss {now:.6g}")
                reason = "" if fit.no_stop else K.stopped(change_w, change_h, before, now, initial, fit.tol)
                if reason or not move:
                    why = reason or "max_iter"
                    if cuts:
                        discard(done)
                    done.unpersist()
                    break
                before = now
            if bound is not None:  # of the last step of W, whose loss is known now
                steps[1] *= 1 / 1.05 if bound - value > 0 else 1.5
                bound = None
            old, h, old_w = h, done, w
            moved, s = s[0], s[1:]
            if fit.line_search and gradient:
                (value_h, slope, square), s = s[:3], s[3:]
                gamma, gap = steps[0], value + slope + steps[0] * square - value_h
                steps[0] = gamma / 1.05 if gap > 0 else gamma * 1.5
            elif fit.line_search and ridge:
                (*kl, cross, old_square, new_square), s = s[: w.shape[1] + 3], s[w.shape[1] + 3 :]
                top = _tops(h)
                gap = 2 * cross - old_square + steps[0] * (top * kl).sum() - new_square
                steps[0] *= 1 / 1.05 if gap > 0 else 1.5
            elif ridge:
                top = _tops(h)
            if cuts:  # nothing reads what was written before
                discard(cut)
                cut = h
            old.unpersist()
            if update_w:
                cells = g.shape[0] * w.shape[1]
                first, second = s[:cells].reshape(g.shape[0], -1), s[cells:]
                sums = (first, second.reshape(w.shape[1], -1) if fit.l2 else second)
                if gradient:
                    grad = K.grad_w(g, sums, g @ w, fit)
                    w = K.step_w(w, grad, steps[1], fit, fixed_w)
                    gap = w - old_w
                    bound = value_h + (gap * grad).sum() + steps[1] * (gap * gap).sum() if fit.line_search else None
                    if bound is not None and refresh:  # the next round's loss is of another G
                        steps[1] *= 1 / 1.05 if bound - _added(_pass(spectra, h, g @ w, None, fit, move=False))[0] > 0 else 1.5
                        bound = None
                else:
                    w = K.update_w(w, g, sums, fit, fixed_w, total)
                g = refresh(w) if refresh else g
            change_w = K.relative_change(w, old_w, fit.tol) if update_w else 0.0
            # H's change is of use only where W's doesn't rule out that both have settled
            change_h = change_of_h(h, moved / (size / g.shape[0] * w.shape[1]), fit.tol) if change_w < fit.tol and not fit.no_stop else np.inf
        result = written(h.select("pixel_id", "h"), "h")
        discard(cut)
        h.unpersist()
    finally:
        spectra.close()
    loss = trace[-1]
    if update_w and not fit.simplex_w and not fit.simplex_h:
        by = K.rescale(gram(result, "h"), np.array(dense_sum(result, "h").first()["total"]))
        plain = penalties(result, fit)
        w, result = w / by, result.withColumn("h", F.zip_with("h", V.literal(by), lambda a, b: a * b))
        loss += (penalties(result, fit) - plain) / size
    seconds = time.perf_counter() - began
    if fit.verbose:
        print(f"{len(trace)} rounds in {seconds:.1f} s: {why}")
    return w / factor, result, {"iterations": len(trace), "loss": float(loss), "trace": trace, "stopped": why, "seconds": seconds, "g": g}


# -- block by block --------------------------------------------------------------------------------------------------


def _block(rows: pd.DataFrame, x: str) -> tuple[pd.DataFrame, np.ndarray]:
    rows = rows.sort_values("pixel_id")
    return rows, K.matrix(pa.array(rows[x], pa.list_(pa.float64())))


def fit_blocks(pixels: DataFrame, g: np.ndarray, fit: Fit, components: dict[int, int] | None = None, x: str = "spectrum") -> DataFrame:
    """(block_id, comp, w): an independent fit of each block, with its own number of components."""
    shared = pixels.sparkSession.sparkContext.broadcast(g)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = fit.change(components=(components or {}).get(int(key[0]), fit.components), seed=fit.seed + int(key[0]))
        w, _, _ = K.factorise(_block(rows, x)[1], shared.value, own)
        return pd.DataFrame({"block_id": int(key[0]), "comp": range(w.shape[1]), "w": list(w.T)})

    return pixels.select("block_id", "pixel_id", x).groupBy("block_id").applyInPandas(run, "block_id int, comp int, w array<double>")


def abundances_by_block(pixels: DataFrame, g: np.ndarray, w: np.ndarray, fit: Fit, x: str = "spectrum") -> DataFrame:
    """(block_id, pixel_id, h): H of each block with W held fixed."""
    shared = pixels.sparkSession.sparkContext.broadcast((g, w))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gg, ww = shared.value
        rows, m = _block(rows, x)
        _, h, _ = K.factorise(m, gg, fit.change(components=ww.shape[1]), w=ww, fixed_w=ww)
        return pd.DataFrame({"block_id": int(key[0]), "pixel_id": rows["pixel_id"], "h": list(h.T)})

    return pixels.select("block_id", "pixel_id", x).groupBy("block_id").applyInPandas(run, "block_id int, pixel_id long, h array<double>")


def levels_of(presences: dict[int, Sequence[int]]) -> list[list[int]]:
    """Blocks in levels: a block comes after all earlier blocks that share a component with it, so that blocks of a level have
    none in common, and each component meets its blocks in their order."""
    free: dict[int, int] = {}
    levels: list[list[int]] = []
    for block in sorted(presences):
        if presences[block]:
            level = max(free.get(c, 0) for c in presences[block])
            free |= {c: level + 1 for c in presences[block]}
            levels += [[]] * (level == len(levels))
            levels[level] = [*levels[level], block]
    return levels


def refine_in_order(pixels: DataFrame, g: np.ndarray, w: np.ndarray, presences: dict[int, Sequence[int]], fit: Fit, x: str = "spectrum") -> np.ndarray:
    """Refit each block's present components and write them back before the next block that has one of them: a block starts
    from the last fit of each of its components. Blocks without a common component run together, a job for each level, which
    reads its own pixels only; each fit is one kernel call on an executor."""
    levels = levels_of(presences)
    if not levels:
        return w.copy()
    w, spark = w.copy(), pixels.sparkSession
    of_block = spark.createDataFrame([(b, i) for i, level in enumerate(levels) for b in level], "block_id int, _level int")
    path = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    placed = pixels.select(F.col("block_id").cast("int").alias("block_id"), "pixel_id", x).join(of_block, "block_id").repartition("_level", "block_id")
    placed.write.partitionBy("_level").parquet(path)

    def fitter(now: np.ndarray):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            own = sorted(presences[int(key[0])])
            fitted, _, _ = K.factorise(_block(rows, x)[1], g, fit.change(components=len(own)), w=now[:, own])
            return pd.DataFrame({"comp": own, "w": list(fitted.T)})

        return run

    try:
        for i in range(len(levels)):
            own = spark.read.schema(placed.schema).parquet(path).where(F.col("_level") == i).drop("_level")
            for r in own.groupBy("block_id").applyInPandas(fitter(w.copy()), "comp int, w array<double>").collect():  # a level has a component once
                w[:, r["comp"]] = r["w"]
    finally:
        delete(spark, path)
    return w
