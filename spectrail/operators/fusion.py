"""Refinement of compositions by a dark-field image: gradient steps, a chemical term and total variation.

By groups, as blocks, each is one image in one task: its pixels' compositions q (array<double>), its image intensity and
its place; a group's size is the user's choice of blocks. A whole image is refined in tiles with margins (tiles.py), and is
never in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import discard, written
from .kernels import matrix
from .stencils import denoise_image, image_cost, weights
from .tiles import TILE, Frame, margin_of, with_tiles


@dataclass(frozen=True)
class Refinement:
    gamma: float = 1.6
    image_weight: float = 0.0  # 0: 1 / elements
    chemical_weight: float = 0.08
    tv_weight: float = 0.15
    eps: float = 0.24
    rounds: int = 30
    tv_rounds: int = 3
    regularise: bool = True


def _scaled(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = a.min(axis=-1, keepdims=True), a.max(axis=-1, keepdims=True)
    span = np.where(high > low, high - low, 1.0)
    return (a - low) / span, low, span


def refine(q: np.ndarray, image: np.ndarray, y: np.ndarray, x: np.ndarray, numbers: Sequence[float], r: Refinement) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q: elements x pixels. Gives the refined percentages, the modelled image and the costs (image, chemical, variation)."""
    z = np.asarray(weights(numbers))[:, None]
    start, low, span = _scaled(q)
    target, image_low, image_span = _scaled(image)
    weight = r.image_weight or 1 / len(numbers)
    now, costs = start.copy(), np.zeros((r.rounds, 3))
    shape = (y.max() + 1, x.max() + 1)
    modelled = (z * now**r.gamma).sum(axis=0)
    for k in range(r.rounds):
        modelled = (z * now**r.gamma).sum(axis=0)
        grad = z * (modelled - target)
        now = now - (r.gamma * now ** (r.gamma - 1) * weight * grad + r.chemical_weight * (1 - start / (now + r.eps)))
        now = np.maximum(now, 0.0)
        if r.regularise:
            for i in range(len(now)):
                grid = np.zeros(shape)
                grid[y, x] = now[i]
                grid = denoise_image(grid, r.tv_weight, r.tv_rounds)
                now[i] = grid[y, x]
                costs[k, 2] += image_cost(grid)
        gap = (z * now**r.gamma).sum(axis=0) - target
        costs[k, 0] = 0.5 * (gap * gap).sum()
        costs[k, 1] = (start * np.log(now + 1e-8) - now).sum()
    full = now * span + low
    whole = full.sum(axis=0)
    shares = 100 * np.divide(full, whole, out=np.zeros_like(full), where=whole != 0)
    return shares, modelled * image_span + image_low, costs


def refine_groups(pixels: DataFrame, numbers: Sequence[float], r: Refinement = Refinement(), key: str = "block_id") -> tuple[DataFrame, DataFrame]:
    """pixels(key, pixel_id, y, x, q, image) gives (key, pixel_id, q, image) and (key, round, image_cost, chemical_cost,
    variation_cost). Both come from one pass, which is written to the shared folder."""

    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pixel_id")
        y, x = (rows[c].to_numpy() - rows[c].min() for c in ("y", "x"))
        q, image, costs = refine(np.array(rows["q"].tolist()).T, rows["image"].to_numpy(float), y, x, numbers, r)
        first = [costs.ravel().tolist()] + [None] * (len(rows) - 1)  # a group's costs stand in its first row
        return pd.DataFrame({key: rows[key].to_numpy(), "pixel_id": rows["pixel_id"].to_numpy(), "q": list(q.T), "image": image, "costs": first})

    own = pixels.select(key, "pixel_id", "y", "x", "q", "image")
    kind = own.schema[key].dataType.simpleString()
    done = written(own.groupBy(key).applyInPandas(run, f"{key} {kind}, pixel_id long, q array<double>, image double, costs array<double>"), "refined")
    rounds = done.where("costs is not null").select(key, F.explode(F.sequence(F.lit(0), F.lit(r.rounds - 1))).alias("round"), "costs")
    at = lambda k: F.get("costs", F.col("round") * 3 + k)
    return done.drop("costs"), rounds.select(key, "round", *(at(k).alias(n) for k, n in enumerate(("image_cost", "chemical_cost", "variation_cost"))))


# -- a whole image ---------------------------------------------------------------------------------------------------

#: Rows of a tile's pass: its pixels, its sums of costs, and the values at the image's edges after each round.
PIXEL, COSTS, EDGE = 0, 1, 2
STATE = "kind int, pixel_id long, y int, x int, start array<double>, target double, now array<double>, modelled double, round int"


def _tile_rounds(table: pa.Table, f: Frame, height: int, width: int, z: np.ndarray, r: Refinement, first: int, rounds: int) -> pa.Table:
    """Some rounds on a tile with its margin: its own pixels after them, a row of its own pixels' and cells' costs, and its
    cells on the image's edges after each round."""
    y, x = (table.column(c).to_numpy() for c in ("y", "x"))
    start, now = (matrix(table.column(c).combine_chunks()) for c in ("start", "now"))
    target, (iy, ix), mine = table.column("target").to_numpy(), (y - f.top, x - f.left), f.mine(y, x)
    weight = r.image_weight or 1 / len(z)
    costs, edges, modelled = np.zeros((rounds, 3)), [], np.zeros(len(y))
    gy, gx = np.mgrid[f.y0 : f.y1, f.x0 : f.x1]
    inside, edge = (gy < height - 1) & (gx < width - 1), (gy == 0) | (gx == 0) | (gy == height - 1) | (gx == width - 1)
    sy, sx = f.inner
    for k in range(rounds):
        modelled = (z * now**r.gamma).sum(axis=0)
        grad = z * (modelled - target)
        now = now - (r.gamma * now ** (r.gamma - 1) * weight * grad + r.chemical_weight * (1 - start / (now + r.eps)))
        now = np.maximum(now, 0.0)
        if r.regularise:
            cells = np.zeros((len(now), int(edge.sum())))
            for i in range(len(now)):
                grid = np.zeros(f.shape)
                grid[iy, ix] = now[i]
                grid = denoise_image(grid, r.tv_weight, r.tv_rounds)
                now[i] = grid[iy, ix]
                own = grid[sy, sx]
                cells[i] = own[edge]
                # the cell after the last of a tile is in its margin; after the image's last one comes the first, elsewhere
                below = np.zeros_like(own)
                below[: grid.shape[0] - sy.start - 1] = grid[sy.start + 1 : sy.stop + 1, sx]
                right = np.zeros_like(own)
                right[:, : grid.shape[1] - sx.start - 1] = grid[sy, sx.start + 1 : sx.stop + 1]
                costs[k, 2] += np.sqrt(1e-8 + (own - below) ** 2 + (own - right) ** 2)[inside].sum()
            edges.append(cells)
        own = now[:, mine]
        gap = (z * own**r.gamma).sum(axis=0) - target[mine]
        costs[k, 0] = 0.5 * (gap * gap).sum()
        costs[k, 1] = (start[:, mine] * np.log(own + 1e-8) - own).sum()
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(m.shape[1] + 1) * m.shape[0], pa.int32()), pa.array(np.ascontiguousarray(m.T).ravel()))
    n, at = int(mine.sum()), [int(edge.sum())] * len(edges)
    parts = [
        [pa.array(np.full(n, PIXEL, np.int32)), pa.array(table.column("pixel_id").to_numpy()[mine]), pa.array(y[mine].astype(np.int32)), pa.array(x[mine].astype(np.int32)), lists(start[:, mine]), pa.array(target[mine]), lists(now[:, mine]), pa.array(modelled[mine]), pa.nulls(n, pa.int32())],
        [pa.array([COSTS], pa.int32()), pa.array([int(inside.sum())], pa.int64()), *(pa.nulls(1, pa.int32()),) * 2, pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.float64()), pa.array([costs.ravel().tolist()], pa.list_(pa.float64())), pa.nulls(1, pa.float64()), pa.nulls(1, pa.int32())],
    ]
    if sum(at):
        m, repeat = sum(at), len(edges)
        of_round = np.repeat(np.arange(first, first + repeat, dtype=np.int32), at)
        parts.append([pa.array(np.full(m, EDGE, np.int32)), pa.nulls(m, pa.int64()), pa.array(np.tile(gy[edge], repeat).astype(np.int32)), pa.array(np.tile(gx[edge], repeat).astype(np.int32)), pa.nulls(m, pa.list_(pa.float64())), pa.nulls(m, pa.float64()), lists(np.concatenate(edges, axis=1)), pa.nulls(m, pa.float64()), pa.array(of_round)])
    names = [c.strip().split(" ")[0] for c in STATE.split(",")]
    return pa.concat_tables([pa.Table.from_arrays(p, names) for p in parts])


def _edge_costs(edges: DataFrame, height: int, width: int, elements: int, rounds: Sequence[int]) -> dict[int, float]:
    """The variation of each round at the last row and column, after which come the first; edges: (round, y, x, now), where
    what is missing is 0."""
    spark, n = edges.sparkSession, F.col("id")
    last = spark.range(width + height - 1).select(F.when(n < width, height - 1).otherwise(n - width).alias("y"), F.when(n < width, n).otherwise(width - 1).alias("x"))
    cells = last.select("y", "x", F.explode(F.array(*map(F.lit, rounds))).alias("round"))
    for name, y, x in (("_here", F.col("y"), F.col("x")), ("_below", (F.col("y") + 1) % height, F.col("x")), ("_right", F.col("y"), (F.col("x") + 1) % width)):
        near = edges.select(F.col("round").alias("_r"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("now").alias(name))
        cells = cells.join(near, (F.col("round") == F.col("_r")) & (y == F.col("_y")) & (x == F.col("_x")), "left").drop("_r", "_y", "_x")
    value = lambda c: F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), elements))
    gap = lambda c: F.zip_with(value("_here"), value(c), lambda a, b: (a - b) * (a - b))
    each = F.aggregate(F.zip_with(gap("_below"), gap("_right"), lambda a, b: F.sqrt(a + b + F.lit(1e-8))), F.lit(0.0), lambda s, v: s + v)
    return {r["round"]: r["cost"] for r in cells.groupBy("round").agg(F.sum(each).alias("cost")).collect()}


def refine_image(pixels: DataFrame, numbers: Sequence[float], r: Refinement = Refinement(), tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """pixels(pixel_id, y, x, q, image) of one image gives (pixel_id, q, image) and (round, image_cost, chemical_cost,
    variation_cost), as refine() does for the whole image, at any size of tiles.

    Bounds of the elements and the image are one aggregate. Between exchanges of rows a tile does as many rounds as its
    margin allows; what is exchanged is written to the shared folder. The driver sees bounds and costs only.
    """
    spark, n = pixels.sparkSession, len(numbers)
    ends = [f(F.get("q", i)).alias(f"{name}{i}") for i in range(n) for name, f in (("low", F.min), ("high", F.max))]
    box = pixels.agg(*ends, *(f(c).alias(f"{name}_{c}") for c in ("y", "x", "image") for name, f in (("low", F.min), ("high", F.max))), F.count(F.lit(1)).alias("n")).first()
    costs_schema = "round int, image_cost double, chemical_cost double, variation_cost double"
    if not box["n"]:
        return pixels.select(F.col("pixel_id").cast("long"), "q", "image"), spark.createDataFrame([], costs_schema)
    height, width = (int(box[f"high_{c}"] - box[f"low_{c}"] + 1) for c in ("y", "x"))
    low, high = (np.array([box[f"{name}{i}"] for i in range(n)], float) for name in ("low", "high"))
    span = np.where(high > low, high - low, 1.0)
    image_low, image_span = box["low_image"], (box["high_image"] - box["low_image"]) or 1.0
    z = np.asarray(weights(numbers))[:, None]
    reach = max(0, r.tv_rounds - 1) if r.regularise else 0
    margin = max(margin_of(tile), reach + 1) if r.regularise else 0
    each = (margin - 1) // reach if reach else r.rounds
    scaled = F.transform(F.arrays_zip(F.col("q").alias("v"), F.lit(low.tolist()).alias("l"), F.lit(span.tolist()).alias("s")), lambda c: (c["v"] - c["l"]) / c["s"])
    at = lambda c: (F.col(c) - box[f"low_{c}"]).cast("int").alias(c)
    state = pixels.select(F.lit(PIXEL).alias("kind"), F.col("pixel_id").cast("long").alias("pixel_id"), at("y"), at("x"), scaled.alias("start"), ((F.col("image") - image_low) / image_span).alias("target"))
    state, before = state.select("*", F.col("start").alias("now"), F.lit(0.0).alias("modelled"), F.lit(None).cast("int").alias("round")), None
    costs = np.zeros((r.rounds, 3))

    def run(first: int, rounds: int) -> Callable[[pa.Table], pa.Table]:
        def of_tile(table: pa.Table) -> pa.Table:
            ty, tx = (table.column(c)[0].as_py() for c in ("ty", "tx"))
            return _tile_rounds(table, Frame.of(ty, tx, tile, margin, height, width), height, width, z, r, first, rounds)

        return of_tile

    for first in range(0, r.rounds, each):
        rounds = min(each, r.rounds - first)
        done = written(with_tiles(state, tile, margin, height, width).groupBy("ty", "tx").applyInArrow(run(first, rounds), STATE), "tiles")
        if before is not None:
            discard(before)
        before, state = done, done.where(F.col("kind") == PIXEL)
        sums = done.where(F.col("kind") == COSTS).select("pixel_id", *(F.get("now", i).alias(f"c{i}") for i in range(3 * rounds)))
        total = sums.agg(F.sum("pixel_id"), *(F.sum(f"c{i}") for i in range(3 * rounds))).first()
        costs[first : first + rounds] = np.reshape(total[1:], (rounds, 3))
        if r.regularise:
            edge = _edge_costs(done.where(F.col("kind") == EDGE).select("round", "y", "x", "now"), height, width, n, range(first, first + rounds))
            empty = ((height - 1) * (width - 1) - total[0]) * n * np.sqrt(1e-8)  # tiles without a pixel near them
            costs[first : first + rounds, 2] += [edge[k] + empty for k in range(first, first + rounds)]
    full = F.transform(F.arrays_zip(F.col("now").alias("v"), F.lit(low.tolist()).alias("l"), F.lit(span.tolist()).alias("s")), lambda c: c["v"] * c["s"] + c["l"])
    whole = F.aggregate("_full", F.lit(0.0), lambda s, v: s + v)
    shares = V.once(whole, lambda s: F.transform("_full", lambda v: F.when(s != 0, 100 * v / s).otherwise(F.lit(0.0))))
    refined = state.select("pixel_id", full.alias("_full"), (F.col("modelled") * image_span + image_low).alias("image")).select("pixel_id", shares.alias("q"), "image")
    return refined, spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(costs)], costs_schema)
