"""Images in tiles: an operator that looks at neighbours runs on squares of pixels, each with a margin of its neighbours'.

A pixel's row goes to its own tile and to those whose margin holds it, so only margins are copied; a tile is one group of
bounded size, whatever the image's. With a margin of m, a tile can do as many steps as m pixels allow before rows are
exchanged again: a step spoils one pixel (or a known number) from the margin's outer edge inwards, and only the tile's own
pixels come back. At the edges of the image tiles have no margin, so that the operator's own rules for edges hold there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, written

#: Side of a tile, and the widest margin that is chosen for it.
TILE = 128


def margin_of(tile: int) -> int:
    return max(1, tile // 16)


def with_tiles(rows: DataFrame, tile: int, margin: int, height: str | int, width: str | int, y: str = "y", x: str = "x") -> DataFrame:
    """A row for each tile (ty, tx) that holds a pixel itself or in its margin. y and x begin at 0."""

    def places(at: str, size: str | int) -> Column:
        size = F.col(size) if isinstance(size, str) else F.lit(size)
        low = F.greatest(F.lit(0), F.floor((F.col(at) - margin) / tile))
        return F.explode(F.sequence(low.cast("int"), F.least(F.floor((size - 1) / tile), F.floor((F.col(at) + margin) / tile)).cast("int")))

    return rows.withColumn("ty", places(y, height)).withColumn("tx", places(x, width))


@dataclass(frozen=True)
class Frame:
    """A tile's place in an image: its own pixels from (y0, x0) to before (y1, x1), with the margin (top, left) to (bottom, right)."""

    y0: int
    x0: int
    y1: int
    x1: int
    top: int
    left: int
    bottom: int
    right: int

    @classmethod
    def of(cls, ty: int, tx: int, tile: int, margin: int, height: int, width: int) -> Frame:
        y0, x0, y1, x1 = ty * tile, tx * tile, min((ty + 1) * tile, height), min((tx + 1) * tile, width)
        return cls(y0, x0, y1, x1, max(0, y0 - margin), max(0, x0 - margin), min(height, y1 + margin), min(width, x1 + margin))

    @property
    def shape(self) -> tuple[int, int]:
        return self.bottom - self.top, self.right - self.left

    @property
    def inner(self) -> tuple[slice, slice]:
        return slice(self.y0 - self.top, self.y1 - self.top), slice(self.x0 - self.left, self.x1 - self.left)

    def mine(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (y >= self.y0) & (y < self.y1) & (x >= self.x0) & (x < self.x1)


def denoise_steps(image: np.ndarray, px: np.ndarray, py: np.ndarray, lam: float, steps: int) -> np.ndarray:
    """Steps of fast gradient projection on one image, which change px and py; gives the image of the last step."""
    out = np.zeros_like(image)
    for _ in range(steps):
        out = image - lam * (px + py)
        out[1:] += lam * px[:-1]
        out[:, 1:] += lam * py[:, :-1]
        px[:-1] += (out[:-1] - out[1:]) / (8 * lam)
        py[:, :-1] += (out[:, :-1] - out[:, 1:]) / (8 * lam)
        length = np.maximum(1.0, np.hypot(px, py))
        px /= length
        py /= length
    return out


def _denoiser(names: list[str], tile: int, margin: int, lam: float, steps: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Steps on a tile with its margin: its own cells after them, those that are missing only where more steps follow."""

    def run(table: pa.Table) -> pa.Table:
        of = lambda c: table.column(c).to_numpy()
        f = Frame.of(int(of("ty")[0]), int(of("tx")[0]), tile, margin, int(of("_h")[0]), int(of("_w")[0]))
        y, x, real = of("y"), of("x"), table.column("real").to_pylist()
        image, px, py, there = np.zeros(f.shape), np.zeros(f.shape), np.zeros(f.shape), np.zeros(f.shape, bool)
        for m, name in ((image, "value"), (px, "px"), (py, "py")):
            m[y - f.top, x - f.left] = of(name)
        there[y - f.top, x - f.left] = real
        out = denoise_steps(image, px, py, lam, steps)
        keep = np.zeros(f.shape, bool)
        keep[f.inner] = (there | (px != 0) | (py != 0))[f.inner] if not last else there[f.inner]
        iy, ix = np.nonzero(keep)
        first = table.slice(0, 1)
        same_for_all = [first.column(c).take(pa.array(np.zeros(len(iy), np.int64))).combine_chunks() for c in (*names, "_y0", "_x0", "_h", "_w")]
        values = np.maximum(out, 0.0)[keep] if last else image[keep]
        columns = [*same_for_all, pa.array((iy + f.top).astype(np.int32)), pa.array((ix + f.left).astype(np.int32)), pa.array(values), pa.array(px[keep]), pa.array(py[keep]), pa.array(there[keep])]
        return pa.Table.from_arrays(columns, [*names, "_y0", "_x0", "_h", "_w", "y", "x", "value", "px", "py", "real"])

    return run


def denoise_maps(cells: DataFrame, lam: float, rounds: int, keys: Sequence[str] = ("element",), tile: int = TILE) -> DataFrame:
    """(keys, y, x, value) with each map denoised in its own rectangle, where cells that are missing count as 0.

    Rows (keys, y, x, value) are exchanged every few rounds; between them stand px and py of each cell, also of missing ones
    that noise has reached. Nulls in a key are a map of their own; an empty table gives an empty result."""
    margin = min(margin_of(tile), rounds)
    names = [f"_k{i}" for i in range(len(keys))]
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    box = cells.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"), (F.max("y") - F.min("y") + 1).alias("_h"), (F.max("x") - F.min("x") + 1).alias("_w"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    on = same[0]
    for one in same[1:]:
        on = on & one
    state = cells.join(box, on).select(*names, "_y0", "_x0", "_h", "_w", (F.col("y") - F.col("_y0")).cast("int").alias("y"), (F.col("x") - F.col("_x0")).cast("int").alias("x"), F.col("value").cast("double").alias("value"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), F.lit(True).alias("real"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    done, before = 0, None
    while True:
        steps = min(margin, rounds - done)
        last = done + steps >= rounds

        found = with_tiles(state, tile, margin, "_h", "_w").groupBy(*names, "_h", "_w", "ty", "tx").applyInArrow(_denoiser(names, tile, margin, lam, steps, last), schema)
        done += steps
        if last:
            break
        state = written(found, "tiles")
        if before is not None:
            discard(before)
        before = state
    at = [(F.col(c) + F.col(f"_{c}0")).cast(kinds[c]).alias(c) for c in ("y", "x")]
    return found.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), *at, "value")
