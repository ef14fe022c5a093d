"""Treetops and crowns: one top for each plateau, growth from tops, and the detection that joins the two."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groveline.functions.curves import diameter
from groveline.operators import raster
from groveline.operators.graph import components

KEY = ("raster_id", "row", "col")


def canonical_rank(values: np.ndarray) -> np.ndarray:
    """A rank of each cell that turns and mirrors with the raster: its place in the least of the eight orientations.

    Where several orientations are equally least, the raster is symmetric and a cell's rank is the least of its places.
    """
    flat = np.where(np.isnan(values), -np.inf, values)
    place = np.arange(values.size).reshape(values.shape)
    frames = [(np.rot90(v, k), np.rot90(p, k)) for v, p in ((flat, place), (flat.T, place.T)) for k in range(4)]
    least = min((v.shape, v.ravel().tolist()) for v, _ in frames)
    rank = np.full(values.size, values.size)
    for v, p in frames:
        if (v.shape, v.ravel().tolist()) == least:
            rank[p.ravel()] = np.minimum(rank[p.ravel()], np.arange(values.size))
    return rank.reshape(values.shape)


def ranks(cells: DataFrame, rasters: DataFrame) -> DataFrame:
    """(raster_id, row, col, rank) of all cells; a raster is a task."""
    kind = cells.schema["raster_id"].dataType.simpleString()

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        values = np.full((int(part["nrows"].iat[0]), int(part["ncols"].iat[0])), np.nan)
        values[part["row"], part["col"]] = part["v"].astype(float)
        return part[list(KEY)].assign(rank=canonical_rank(values)[part["row"], part["col"]])

    return cells.join(rasters.select("raster_id", "nrows", "ncols"), "raster_id").groupBy("raster_id").applyInPandas(rank, f"raster_id {kind}, row int, col int, rank long")


def treetops(candidates: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """One top (raster_id, label, row, col, v) of each plateau of touching candidates of equal height.

    The cell nearest the plateau's centre stands for it. Labels run from 1, tallest first. Ties go by
    ``ranked`` (of ``ranks``, best of the unsmoothed raster), else by row and column.
    """
    c = candidates.select(*KEY, "v")
    c = c.join(ranked, list(KEY), "left") if ranked is not None else c.withColumn("rank", F.col("row").cast("long") * (1 << 32) + F.col("col"))
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(k).alias("c")) for r, k in ((0, 1), (1, -1), (1, 0), (1, 1))))
    near = c.withColumn("s", F.explode(steps)).select(F.struct(*KEY).alias("a"), "raster_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "v")
    edges = near.alias("n").join(c.select(*KEY, "v").alias("m"), [*KEY, "v"]).select("a", F.struct(*KEY).alias("b"))
    plateau = components(edges).select(F.col("id").alias("at"), "component")
    own = c.withColumn("at", F.struct(*KEY)).join(plateau, "at", "left").withColumn("plateau", F.coalesce("component", "at"))
    whole = Window.partitionBy("plateau")
    n = F.count(F.lit(1)).over(whole)
    far = (F.col("row") * n - F.sum("row").over(whole)) ** 2 + (F.col("col") * n - F.sum("col").over(whole)) ** 2
    first = own.withColumn("far", far).withColumn("k", F.row_number().over(whole.orderBy("far", "rank"))).filter("k = 1")
    label = F.row_number().over(Window.partitionBy("raster_id").orderBy(F.desc("v"), "rank"))
    return first.select(*KEY, "v", label.alias("label")).select("raster_id", "label", "row", "col", "v")


def _claimable(values: np.ndarray, r: int, c: int, size: float, least: float, drop: float, base: float, slope: float) -> tuple[slice, slice, np.ndarray, np.ndarray]:
    """The window of cells that a crown with this top may hold at all, and their squared distances to the top in cells."""
    top = values[r, c]
    reach = base + slope * max(top, 0.0)
    span = int(reach / size) + 1
    rows, cols = slice(max(r - span, 0), r + span + 1), slice(max(c - span, 0), c + span + 1)
    part = values[rows, cols]
    far = (np.arange(rows.start, rows.start + part.shape[0])[:, None] - r) ** 2 + (np.arange(cols.start, cols.start + part.shape[1])[None] - c) ** 2
    with np.errstate(invalid="ignore"):
        return rows, cols, (part >= max(least, drop * top)) & (np.sqrt(far) * size <= reach), far


def _grow(values: np.ndarray, tops: list[tuple[int, int, int]], size: float, least: float, drop: float, base: float, slope: float) -> np.ndarray:
    """Labels of the cells that crowns reach; 0 elsewhere.

    What each crown may hold is a mask of its own window. Of all cells held whose neighbours haven't been
    looked at, the highest goes first, then the one nearest to its top, then the lower label; it gives its
    free neighbours to its crown, unless such a neighbour is higher than both the cell and the crown's top.
    """
    ncols = values.shape[1]
    # Heights as whole numbers, the highest 0: a cell's turn is then a tuple of whole numbers.
    level = np.full(values.shape, -1)
    level[~np.isnan(values)] = np.unique(-values[~np.isnan(values)], return_inverse=True)[1]
    labels, may, turns = np.zeros(values.shape, np.int32), {}, []
    for label, r, c in tops:
        may[label] = (*_claimable(values, r, c, size, least, drop, base, slope), level[r, c])
        labels[r, c] = label
        turns.append((int(level[r, c]), 0, label, r * ncols + c))
    heapq.heapify(turns)
    while turns:
        height, _, label, at = heapq.heappop(turns)
        rows, cols, mask, far, top = may[label]
        r, c = divmod(at, ncols)
        block = slice(max(r - 1, rows.start), r + 2), slice(max(c - 1, cols.start), c + 2)
        inner = slice(block[0].start - rows.start, r + 2 - rows.start), slice(block[1].start - cols.start, c + 2 - cols.start)
        ok = mask[inner]
        near = labels[block][: ok.shape[0], : ok.shape[1]], level[block][: ok.shape[0], : ok.shape[1]]
        free = ok & (near[0] == 0) & (near[1] >= min(height, top))
        for i, j in zip(*np.nonzero(free), strict=True):
            row, col = block[0].start + int(i), block[1].start + int(j)
            labels[row, col] = label
            heapq.heappush(turns, (int(level[row, col]), int(far[row - rows.start, col - cols.start]), label, row * ncols + col))
    return labels


def crown_cells(cells: DataFrame, rasters: DataFrame, tops: DataFrame, min_height: float = 2.0, drop: float = 0.45, base: float = 1.0, slope: float = 0.1) -> DataFrame:
    """(raster_id, row, col, v, label) of the cells in crowns. Growth is sequential, so a raster is one task."""
    placed = tops.select(*KEY, "label")
    every = raster.valid(cells).select(*KEY, "v").join(placed, list(KEY), "left").join(rasters.select("raster_id", "nrows", "ncols", "cellsize"), "raster_id")

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        values = np.full((int(part["nrows"].iat[0]), int(part["ncols"].iat[0])), np.nan)
        values[part["row"], part["col"]] = part["v"]
        seeds = part.dropna(subset=["label"]).sort_values("label")
        seeds = [(int(k), int(r), int(c)) for k, r, c in zip(seeds["label"], seeds["row"], seeds["col"], strict=True)]
        labels = _grow(values, seeds, float(part["cellsize"].iat[0]), min_height, drop, base, slope)
        r, c = np.nonzero(labels)
        return pd.DataFrame({"raster_id": part["raster_id"].iat[0], "row": r, "col": c, "v": values[r, c], "label": labels[r, c]})

    return every.groupBy("raster_id").applyInPandas(grow, "raster_id string, row int, col int, v double, label int")


def crowns(grown: DataFrame, tops: DataFrame, rasters: DataFrame, min_cells: int = 3) -> DataFrame:
    """A row for each crown of ``min_cells`` or more, numbered from 1, tallest first."""
    t = tops.select("raster_id", "label", F.col("row").alias("top_row"), F.col("col").alias("top_col"), F.col("v").alias("height"))
    size = rasters.select("raster_id", "cellsize")
    far = F.sqrt((F.col("row") - F.col("top_row")) ** 2 + (F.col("col") - F.col("top_col")) ** 2) * F.col("cellsize")
    one = grown.join(t, ["raster_id", "label"]).join(size, "raster_id").groupBy("raster_id", "label", "top_row", "top_col", "height").agg(
        F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * F.first("cellsize") ** 2).alias("area"), F.avg("v").alias("mean_height"), F.max(far).alias("max_extent"))
    rank = F.row_number().over(Window.partitionBy("raster_id").orderBy("label"))
    return one.filter(F.col("cells") >= min_cells).withColumn("crown_id", rank).withColumn("diameter", 2 * F.sqrt(F.col("area") / math.pi)).drop("label")


def detect_trees(cells: DataFrame, rasters: DataFrame, min_height: float = 2.0, smooth: int = 1, min_cells: int = 3) -> DataFrame:
    """Crowns of rasters: smooth by the mean, find tops, grow crowns. Heights are the smoothed ones, ties go by the raw raster."""
    smoothed = raster.smooth_mean(cells, smooth) if smooth else cells
    tops = treetops(raster.treetop_candidates(smoothed, rasters, min_height), ranks(cells, rasters))
    return crowns(crown_cells(smoothed, rasters, tops, min_height), tops, rasters, min_cells)


def inventory_of(crowns: DataFrame, rasters: DataFrame, species: str = "", prefix: str = "D", family: str | None = None, params: tuple[float, ...] = ()) -> DataFrame:
    """Crowns as inventory rows: the plot is the raster, ids are ``prefix`` and number, diameters come from a curve if one is given."""
    cs = F.col("cellsize")
    at = crowns.join(rasters.select("raster_id", "nrows", "xll", "yll", "cellsize"), "raster_id")
    dbh = diameter(family, F.col("height"), params) if family else F.lit(None).cast("double")
    return at.select(F.concat(F.lit(prefix), F.col("crown_id").cast("string")).alias("tree_id"), F.col("raster_id").alias("plot_id"), F.lit(species).alias("species"), F.lit("live").alias("status"), dbh.alias("dbh_cm"), F.col("height").alias("height_m"),
                     F.col("diameter").alias("crown_diameter_m"), (F.col("xll") + (F.col("top_col") + 0.5) * cs).alias("x"), (F.col("yll") + (F.col("nrows") - F.col("top_row") - 0.5) * cs).alias("y"))


def density(crowns: DataFrame, rasters: DataFrame, area_ha: Column | None = None) -> DataFrame:
    """Crowns a hectare of each raster, over its own area unless another is given."""
    area = area_ha if area_ha is not None else F.col("nrows") * F.col("ncols") * F.col("cellsize") ** 2 / 10_000
    n = crowns.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n"))
    return rasters.join(n, "raster_id", "left").select("raster_id", (F.coalesce("n", F.lit(0)) / area).alias("per_ha"))
