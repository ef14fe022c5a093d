"""Openings by width: which cells a circle of a given radius covers, and the largest circle in a gap.

Lengths are in cells. A point's clearance is its distance to the nearest wall: a blocked cell's square
or the raster's edge. It changes by no more than a point moves, so a square whose centre has clearance
d holds no point of more than d plus half its diagonal; nor can a point have more than half of the
open run, along its row or column, that it lies in. Squares are split while these bounds leave
something open, which finds circles centred anywhere, not only at cell centres.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("raster_id", "row", "col")
SLACK = 1e-9
#: Cells a side of the blocks that a raster is opened in.
TILE = 256
_HALF = math.sqrt(0.5)


class Walls:
    """Blocked cells of a block; outside of it everything is blocked."""

    def __init__(self, blocked: np.ndarray):
        self.open = np.pad(~blocked, 1)
        edge = np.zeros_like(self.open)  # only blocked cells that touch an open one can be nearest
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                edge |= np.roll(np.roll(self.open, dr, 0), dc, 1)
        near = ~self.open & edge
        self.rows, self.cols = (x - 1 for x in np.nonzero(near))
        order = np.argsort(self.rows, kind="stable")
        self.rows, self.cols = self.rows[order], self.cols[order]

    def clearance(self, y: np.ndarray, x: np.ndarray, reach: float = math.inf) -> np.ndarray:
        """Of points (cell (r, c) spans [r, r + 1) x [c, c + 1)); farther than ``reach`` may read as ``reach``."""
        out = np.full(len(y), reach)
        if not len(y) or not len(self.rows):
            return out
        step = max(1, (1 << 22) // max(1, len(self.rows)))
        for i in range(0, len(y), step):
            p, q = y[i : i + step], x[i : i + step]
            rows, cols = self.rows, self.cols
            if reach < math.inf:
                a, b = np.searchsorted(rows, [p.min() - reach - 1, p.max() + reach + 1])
                rows, cols = rows[a:b], cols[a:b]
                inside = (cols >= q.min() - reach - 1) & (cols <= q.max() + reach + 1)
                rows, cols = rows[inside], cols[inside]
            if len(rows):
                dy = np.maximum(np.maximum(rows[None] - p[:, None], p[:, None] - rows[None] - 1), 0)
                dx = np.maximum(np.maximum(cols[None] - q[:, None], q[:, None] - cols[None] - 1), 0)
                out[i : i + step] = np.minimum(out[i : i + step], np.sqrt((dy * dy + dx * dx).min(1)))
        return out

    def runs(self) -> np.ndarray:
        """For each open cell half the shorter of the open runs along its row and column."""
        inner = self.open[1:-1, 1:-1]
        both = np.zeros(inner.shape)
        for view, out in ((inner, both), (inner.T, both.T)):
            length = np.zeros(view.shape)
            for r in range(view.shape[0]):
                line = np.concatenate([[0], view[r].astype(np.int8), [0]])
                start, end = np.flatnonzero(np.diff(line) == 1), np.flatnonzero(np.diff(line) == -1)
                for s, e in zip(start, end, strict=True):
                    length[r, s:e] = (e - s) / 2
            out[:] = length if not both.any() else np.minimum(out, length)
        return both


def _corners(y: np.ndarray, x: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([y - half, y - half, y + half, y + half]), np.concatenate([x - half, x + half, x - half, x + half])


def largest_circle(members: np.ndarray, slack: float = 1e-7) -> tuple[float, float, float]:
    """Radius, y and x of the largest circle in a component's cells, centred in one of them (to within ``slack``)."""
    walls = Walls(~members)
    runs = walls.runs()
    rows, cols = np.nonzero(members)
    y, x, half = rows + 0.5, cols + 0.5, 0.5
    clear = walls.clearance(y, x)
    at = int(clear.argmax())
    best = (float(clear[at]), float(y[at]), float(x[at]))
    while len(y):
        limit = np.minimum(clear + half * 2 * _HALF, runs[np.minimum(y.astype(int), runs.shape[0] - 1), np.minimum(x.astype(int), runs.shape[1] - 1)])
        keep = limit > best[0] + slack
        y, x, half = y[keep], x[keep], half / 2
        if not len(y):
            break
        y, x = _corners(y, x, half)
        clear = walls.clearance(y, x)
        at = int(clear.argmax())
        if clear[at] > best[0]:
            best = (float(clear[at]), float(y[at]), float(x[at]))
        if half == 0.25:  # walls meet at whole coordinates, so circles often centre on half ones
            for edge_y, edge_x in (_corners(y, x, half),):
                inside = (edge_y > 0) & (edge_x > 0) & (edge_y < members.shape[0]) & (edge_x < members.shape[1])
                c = walls.clearance(edge_y[inside], edge_x[inside])
                if len(c) and c.max() > best[0]:
                    k = int(c.argmax())
                    best = (float(c[k]), float(edge_y[inside][k]), float(edge_x[inside][k]))
    return best


def opened(blocked: np.ndarray, radius: float) -> np.ndarray:
    """Open cells whose centre some circle of ``radius`` covers that no wall cuts."""
    walls = Walls(blocked)
    r, c = np.nonzero(~blocked)
    clear = np.zeros(blocked.shape)
    reach = radius + 2
    clear[r, c] = walls.clearance(r + 0.5, c + 0.5, reach)
    runs = walls.runs()
    wanted = radius - SLACK
    held = (clear >= wanted) & ~blocked
    hopeful = (np.minimum(clear + _HALF, runs) >= wanted) & ~blocked
    span = math.ceil(radius + 1)
    steps = [(i, j) for i in range(-span, span + 1) for j in range(-span, span + 1)]
    covered, maybe = np.zeros_like(blocked), np.zeros_like(blocked)
    for i, j in steps:
        near = math.hypot(i, j) <= radius + SLACK
        if not near and math.hypot(i, j) > radius + _HALF + SLACK:
            continue
        a, b = max(0, -i), max(0, -j)
        size = (max(0, blocked.shape[0] - abs(i)), max(0, blocked.shape[1] - abs(j)))
        here, there = (slice(a, a + size[0]), slice(b, b + size[1])), (slice(a + i, a + i + size[0]), slice(b + j, b + j + size[1]))
        if near:
            covered[here] |= held[there]
        maybe[here] |= hopeful[there]
    covered &= ~blocked
    for row, col in zip(*np.nonzero(maybe & ~covered & ~blocked), strict=True):
        a, b = max(0, row - span), max(0, col - span)
        rows, cols = np.nonzero(hopeful[a : row + span + 1, b : col + span + 1])
        covered[row, col] = _reached(walls, runs, rows + a + 0.5, cols + b + 0.5, row + 0.5, col + 0.5, radius, wanted, reach)
    return covered


def _reached(walls: Walls, runs: np.ndarray, y: np.ndarray, x: np.ndarray, py: float, px: float, radius: float, wanted: float, reach: float) -> bool:
    """Whether one of the squares round (y, x) holds a point of the wanted clearance within ``radius`` of (py, px)."""
    half = 0.5
    for _ in range(34):
        far = np.hypot(np.maximum(np.abs(y - py) - half, 0), np.maximum(np.abs(x - px) - half, 0)) <= radius + SLACK
        y, x = y[far], x[far]
        if not len(y):
            return False
        # Of each square the point nearest to p, and the centre, are tried.
        ny, nx = np.clip(py, y - half, y + half), np.clip(px, x - half, x + half)
        clear = walls.clearance(y, x, reach)
        if ((clear >= wanted) & (np.hypot(y - py, x - px) <= radius + SLACK)).any() or (walls.clearance(ny, nx, reach) >= wanted).any():
            return True
        limit = np.minimum(clear + half * 2 * _HALF, runs[np.minimum(y.astype(int), runs.shape[0] - 1), np.minimum(x.astype(int), runs.shape[1] - 1)])
        keep = limit >= wanted
        half /= 2
        y, x = _corners(y[keep], x[keep], half)
    return False


def opened_cells(cells: DataFrame, rasters: DataFrame, threshold: float, radius: float) -> DataFrame:
    """(raster_id, row, col, v) of the cells below ``threshold`` that a circle of ``radius`` (map units) between walls covers.

    Whether a cell is covered depends on walls within twice the radius, so a raster is opened in blocks
    of ``TILE`` cells a side, each with that margin: a large raster is many tasks.
    """
    if not 0 < radius < math.inf:
        raise ValueError("radius must be positive and finite")
    size = rasters.select("raster_id", "nrows", "ncols", "cellsize")
    every = cells.join(size, "raster_id").withColumn("r", F.lit(radius) / F.col("cellsize"))
    halo = (F.ceil(2 * F.col("r")) + 2).cast("int")
    tiles = lambda at, n: F.sequence(F.floor(F.greatest(F.col(at) - halo, F.lit(0)) / TILE), F.floor(F.least(F.col(at) + halo, F.col(n) - 1) / TILE))
    spread = every.withColumn("ti", F.explode(tiles("row", "nrows"))).withColumn("tj", F.explode(tiles("col", "ncols")))

    def open_(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[0]
        # A block's margin is blocked beyond the raster alone: elsewhere its outer cells are too far away to matter.
        top, left = int(part["row"].min()), int(part["col"].min())
        v = np.full((int(part["row"].max()) - top + 1, int(part["col"].max()) - left + 1), np.nan)
        v[part["row"] - top, part["col"] - left] = part["v"].astype(float)
        found = opened(~(v < threshold), float(one["r"]))
        r, c = np.nonzero(found)
        own = ((r + top) // TILE == int(one["ti"])) & ((c + left) // TILE == int(one["tj"]))
        return pd.DataFrame({"raster_id": one["raster_id"], "row": r[own] + top, "col": c[own] + left, "v": v[r[own], c[own]]})

    kind = cells.schema["raster_id"].dataType.simpleString()
    return spread.groupBy("raster_id", "ti", "tj").applyInPandas(open_, f"raster_id {kind}, row int, col int, v double")


def widths(labelled: DataFrame) -> DataFrame:
    """(raster_id, label, radius) in cells of the largest circle in each component's own cells. A component is a task."""

    def widest(part: pd.DataFrame) -> pd.DataFrame:
        top, left = int(part["row"].min()), int(part["col"].min())
        members = np.zeros((int(part["row"].max()) - top + 1, int(part["col"].max()) - left + 1), bool)
        members[part["row"] - top, part["col"] - left] = True
        return pd.DataFrame({"raster_id": [part["raster_id"].iat[0]], "label": [part["label"].iat[0]], "radius": [largest_circle(members)[0]]})

    kind = labelled.schema["raster_id"].dataType.simpleString()
    return labelled.select(*KEY, "label").groupBy("raster_id", "label").applyInPandas(widest, f"raster_id {kind}, label long, radius double")
