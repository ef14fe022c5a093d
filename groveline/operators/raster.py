"""Raster operators on long-form cells (raster_id, row, col, v); nodata is null and stays null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groveline.operators.graph import components

KEY = ("raster_id", "row", "col")
# Breaks of the strata and their names.
STRATA_BREAKS = (0.5, 2.0, 5.0, 15.0, 25.0)
STRATA = ("ground", "regeneration", "understorey", "midstorey", "canopy", "emergent")
FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
EIGHT = (*FOUR, (-1, -1), (-1, 1), (1, -1), (1, 1))


def scaffold(rasters: DataFrame) -> DataFrame:
    """Every (raster_id, row, col)."""
    rows = rasters.select("raster_id", "ncols", F.explode(F.sequence(F.lit(0), (F.col("nrows") - 1).cast("int"))).alias("row"))
    return rows.select("raster_id", "row", F.explode(F.sequence(F.lit(0), (F.col("ncols") - 1).cast("int"))).alias("col"))


def valid(cells: DataFrame) -> DataFrame:
    return cells.filter("v IS NOT NULL")


def mapped(cells: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """Any column function of the value; null stays null."""
    return cells.withColumn("v", F.when(F.col("v").isNotNull(), f(F.col("v"))))


def clamped(cells: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    def f(v: Column) -> Column:
        v = v if low is None else F.greatest(v, F.lit(low))
        return v if high is None else F.least(v, F.lit(high))

    return mapped(cells, f)


def filled(cells: DataFrame, value: float) -> DataFrame:
    return cells.withColumn("v", F.coalesce("v", F.lit(value)))


def centres(cells: DataFrame, rasters: DataFrame) -> DataFrame:
    cs = F.col("cellsize")
    return cells.join(rasters, "raster_id").select(*cells.columns, (F.col("xll") + (F.col("col") + 0.5) * cs).alias("x"), (F.col("yll") + (F.col("nrows") - F.col("row") - 0.5) * cs).alias("y"))


def located(points: DataFrame, rasters: DataFrame) -> DataFrame:
    """Add row and col of each point (raster_id, x, y): null outside; the far edges belong to the last cells."""
    c, r = (F.col("x") - F.col("xll")) / F.col("cellsize"), F.col("nrows") - (F.col("y") - F.col("yll")) / F.col("cellsize")
    inside = c.between(0, F.col("ncols")) & r.between(0, F.col("nrows"))
    at = lambda k, n: F.least(F.floor(k), F.col(n) - 1).cast("int")
    # A row's lower edge is part of the row above it only at the very south.
    row = F.when(F.col("y") == F.col("yll"), F.col("nrows") - 1).otherwise(F.col("nrows") - 1 - F.least(F.floor((F.col("y") - F.col("yll")) / F.col("cellsize")), F.col("nrows") - 1)).cast("int")
    return points.join(rasters, "raster_id").select(*points.columns, F.when(inside, row).alias("row"), F.when(inside, at(c, "ncols")).alias("col"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Raster headers of ``a`` joined with ``b``; a mismatch raises: shape, cell size, origin, then reference system."""
    y = b.select("raster_id", *(F.col(c).alias(f"b_{c}") for c in ("ncols", "nrows", "xll", "yll", "cellsize", "crs")))
    cs = F.least("cellsize", "b_cellsize")
    why = (F.when((F.col("ncols") != F.col("b_ncols")) | (F.col("nrows") != F.col("b_nrows")), "shape")
           .when(F.abs(F.col("cellsize") - F.col("b_cellsize")) > 1e-9 * F.greatest("cellsize", "b_cellsize"), "cell size")
           .when((F.abs(F.col("xll") - F.col("b_xll")) > 1e-6 * cs) | (F.abs(F.col("yll") - F.col("b_yll")) > 1e-6 * cs), "origin").when(F.col("crs") != F.col("b_crs"), "reference system"))
    return a.join(y, "raster_id").withColumn("aligned", F.when(why.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("rasters differ in "), why)).cast("boolean"))).filter("aligned").select(*a.columns)


def combined(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], headers: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Cell by cell; null if either is. A cell that only one of them has raises; ``headers`` are compared by ``aligned``."""
    if headers:
        a = a.join(aligned(*headers).select("raster_id"), "raster_id", "left_semi")
    x, y = a.select(*KEY, "v", F.lit(True).alias("_a")), b.select(*KEY, F.col("v").alias("w"), F.lit(True).alias("_b"))
    both = F.when(F.col("_a") & F.col("_b"), True).otherwise(F.raise_error(F.lit("rasters differ in shape")).cast("boolean"))
    return x.join(y, list(KEY), "full").filter(both).select(*KEY, F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), f(F.col("v"), F.col("w"))).alias("v"))


def canopy_height(dsm: DataFrame, dtm: DataFrame, floor: float = 0.0, headers: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return combined(dsm, dtm, lambda s, t: F.greatest(s - t, F.lit(floor)), headers)


def offsets(radius: int, circular: bool = True) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(r, c) for r in span for c in span if not circular or r * r + c * c <= radius * radius]


def moved(cells: DataFrame, steps: Sequence[tuple[int, int]]) -> DataFrame:
    """Each valid cell's value at the cells it is a neighbour of: static offsets, so one expand and no join."""
    away = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps)))
    return valid(cells).withColumn("_s", away).select("raster_id", (F.col("row") - F.col("_s.r")).alias("row"), (F.col("col") - F.col("_s.c")).alias("col"), F.col("v").alias("w"))


def focal(cells: DataFrame, how: Callable[[Column], Column], radius: int = 1, circular: bool = True, min_valid: int = 1) -> DataFrame:
    """An aggregate over the window of each valid cell: values scatter with map-side combining, no window join."""
    scattered = moved(cells, offsets(radius, circular)).withColumn("_c", F.lit(None).cast("boolean"))
    centre = valid(cells).select(*KEY, F.lit(None).cast("double").alias("w"), F.lit(True).alias("_c"))
    out = scattered.unionByName(centre).groupBy(*KEY).agg(how(F.col("w")).alias("v"), F.count("w").alias("n"), F.max("_c").alias("c"))
    return out.filter("c").select(*KEY, F.when(F.col("n") >= min_valid, F.col("v")).alias("v"))


def smooth_mean(cells, radius=1):
    return focal(cells, F.avg, radius)


def smooth_median(cells, radius=1):
    return focal(cells, lambda w: F.percentile(w, 0.5), radius)


def focal_max(cells, radius=1):
    return focal(cells, F.max, radius)


def neighbours(cells: DataFrame, connectivity: int = 8) -> DataFrame:
    """How many valid neighbours each valid cell has."""
    near = moved(cells, EIGHT if connectivity == 8 else FOUR).groupBy(*KEY).agg(F.count(F.lit(1)).alias("neighbours"))
    return valid(cells).join(near, list(KEY), "left").select(*KEY, F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def stats(cells: DataFrame) -> DataFrame:
    v = F.col("v")
    return cells.groupBy("raster_id").agg(F.count(v).alias("count"), F.count_if(v.isNull()).alias("nodata_count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("stdev"))


def histogram(cells: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """Equal bins, the top one closed; values outside are left out and empty bins are kept."""
    high = high if high > low else low + 1
    width = (high - low) / bins
    k = F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / width).cast("int"))
    found = cells.filter(F.col("v").between(low, high)).groupBy("raster_id", k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = valid(cells).select("raster_id").distinct().select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(found, ["raster_id", "bin"], "left").select("raster_id", "bin", (low + F.col("bin") * width).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))


def canopy(cells: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Cover, gap fraction and rugosity of each raster."""
    v = F.col("v")
    tall = F.when(v >= threshold, v)
    return cells.groupBy("raster_id").agg(F.coalesce(F.try_divide(F.count(tall), F.count(v)), F.lit(0.0)).alias("cover"), F.coalesce(F.try_divide(F.count_if(v < threshold), F.count(v)), F.lit(0.0)).alias("gap_fraction"), F.coalesce(F.stddev_samp(tall), F.lit(0.0)).alias("rugosity"))


def strata(cells: DataFrame, breaks: Sequence[float] = STRATA_BREAKS) -> DataFrame:
    names = STRATA if tuple(breaks) == STRATA_BREAKS else tuple(f"stratum_{i}" for i in range(len(breaks) + 1))
    k = F.lit(len(breaks))
    for i in range(len(breaks) - 1, -1, -1):
        k = F.when(F.col("v") < breaks[i], i).otherwise(k)
    found = valid(cells).groupBy("raster_id", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    every = cells.select("raster_id").distinct().select("raster_id", F.posexplode(F.array(*map(F.lit, names))).alias("k", "stratum"))
    total = F.sum("n").over(Window.partitionBy("raster_id"))
    return every.join(found, ["raster_id", "k"], "left").select("raster_id", "stratum", F.coalesce(F.col("n") / total, F.lit(0.0)).alias("share"))


def block_max(cells: DataFrame, size: int) -> DataFrame:
    return cells.groupBy("raster_id", F.floor(F.col("row") / size).cast("int").alias("row"), F.floor(F.col("col") / size).cast("int").alias("col")).agg(F.max("v").alias("v"))


def blocked(cells: DataFrame, threshold: float = 2.0) -> DataFrame:
    return cells.withColumn("blocked", F.col("v").isNull() | (F.col("v") >= threshold))


def _across(vert: np.ndarray) -> np.ndarray:
    """Along one row: the least distance to what lies ``vert`` above or below each column (nan: nothing does), or to either end."""
    n = len(vert)
    best = np.minimum(np.arange(n), np.arange(n)[::-1]) + 0.5
    best = np.fmin(best, vert) ** 2
    square = np.where(np.isnan(vert), np.inf, vert * vert)
    for step in range(1, n):
        aside = (step - 0.5) ** 2
        if aside >= best.max():  # no column is that far from what it has found
            break
        np.minimum(best[step:], square[:-step] + aside, out=best[step:])
        np.minimum(best[:-step], square[step:] + aside, out=best[:-step])
    return np.sqrt(best)


def distance_field(cells: DataFrame, rasters: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Distance of each cell centre to the nearest blocked square or the raster's edge, in map units.

    Pass one finds the vertical gap in each column by two ordered windows; pass two takes, in each row
    as a whole, the least combination with other columns, as far aside as any cell of the row still needs.
    """
    b = blocked(cells, threshold).join(rasters.select("raster_id", "nrows", "cellsize"), "raster_id")
    col = Window.partitionBy("raster_id", "col").orderBy("row")
    hit = F.when(F.col("blocked"), F.col("row"))
    up, down = F.last(hit, ignorenulls=True).over(col), F.first(hit, ignorenulls=True).over(col.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("row") - up, down - F.col("row"))
    edge = F.least(F.col("row"), F.col("nrows") - 1 - F.col("row")) + 0.5
    vert = F.when(F.col("blocked"), 0.0).otherwise(F.least(F.coalesce(gap - 0.5, edge), edge))
    b = b.select(*KEY, "blocked", "cellsize", vert.cast("double").alias("vert"))

    def across(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("col", ignore_index=True)
        far = np.where(part["blocked"], 0.0, _across(part["vert"].to_numpy(float)))
        return part[list(KEY)].assign(distance=far * part["cellsize"].iat[0])

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in KEY)
    return b.groupBy("raster_id", "row").applyInPandas(across, f"{kinds}, distance double")


def reflex_corners(cells: DataFrame, rasters: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Lattice points with three open cells of four around them, or two on a diagonal; (row, col) is the cell to their south-east."""
    open_ = blocked(cells, threshold).filter("NOT blocked")
    around = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1))))
    at = open_.withColumn("_s", around).select("raster_id", (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), (F.col("_s.r") == F.col("_s.c")).cast("int").alias("same"))
    n = at.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("same"))
    return n.filter("n = 3 OR n = 2 AND same IN (0, 2)").select(*KEY)


def wall_runs(cells: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Maximal straight walls between open cells and the rest: (raster_id, side, line, first, last)."""
    open_ = blocked(cells, threshold).filter("NOT blocked").select(*KEY)
    parts = []
    for side, (dr, dc) in {"north": (-1, 0), "south": (1, 0), "west": (0, -1), "east": (0, 1)}.items():
        other = open_.select("raster_id", (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"))
        line, along = ("row", "col") if dr else ("col", "row")
        parts.append(open_.join(other, list(KEY), "left_anti").select("raster_id", F.lit(side).alias("side"), F.col(line).alias("line"), F.col(along).alias("at")))
    edges = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    w = Window.partitionBy("raster_id", "side", "line").orderBy("at")
    runs = edges.withColumn("run", F.col("at") - F.row_number().over(w))
    return runs.groupBy("raster_id", "side", "line", "run").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("run")


def labelled(open_cells: DataFrame, rasters: DataFrame, connectivity: int = 8) -> DataFrame:
    """Connected components of the given cells; ``label`` is the least row-major index in each."""
    steps = ((0, 1), (1, 0)) if connectivity == 4 else ((0, 1), (1, 0), (1, 1), (1, -1))
    node = lambda r, c: F.struct(F.col("raster_id").alias("raster_id"), r.alias("row"), c.alias("col"))
    a = open_cells.select(*KEY)
    away = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps)))
    b = a.withColumn("_s", away).select("raster_id", F.col("row").alias("r0"), F.col("col").alias("c0"), (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"))
    edges = b.join(a, list(KEY)).select(node(F.col("row"), F.col("col")).alias("a"), node(F.col("r0"), F.col("c0")).alias("b"))
    found = components(edges).select("id.raster_id", "id.row", "id.col", F.col("component.row").alias("r0"), F.col("component.col").alias("c0"))
    out = a.join(found, list(KEY), "left").join(rasters.select("raster_id", "ncols"), "raster_id")
    return out.select(*KEY, (F.coalesce("r0", "row").cast("long") * F.col("ncols") + F.coalesce("c0", "col")).alias("label"))


def border_reaching(cells: DataFrame, rasters: DataFrame, threshold: float = 2.0, connectivity: int = 8) -> DataFrame:
    """Cells (raster_id, row, col) of the components below ``threshold`` that reach the raster's border."""
    lab = labelled(cells.filter(F.col("v") < threshold), rasters, connectivity).join(rasters.select("raster_id", "nrows", "ncols"), "raster_id")
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("nrows") - 1) | (F.col("col") == F.col("ncols") - 1)
    reach = lab.groupBy("raster_id", "label").agg(F.bool_or(edge).alias("edge")).filter("edge").drop("edge")
    return lab.join(reach, ["raster_id", "label"], "left_semi").select(*KEY)


def gaps(cells: DataFrame, rasters: DataFrame, threshold: float = 2.0, min_area: float = 25.0, connectivity: int = 8, include_edge: bool = True, min_width: float = 0.0, with_width: bool = False) -> DataFrame:
    """Canopy gaps of at least ``min_area``, largest first.

    ``min_width`` (map units) first opens the cells below ``threshold`` by a circle of that diameter. A
    gap touches the edge if the component of unopened cells that it is part of does. ``with_width``
    adds ``width``: the diameter of the largest circle in the gap's own cells.
    """
    from groveline.operators import openings

    if not (0 <= min_area < float("inf") and 0 <= min_width < float("inf")):
        raise ValueError("min_area and min_width must be finite and not negative")
    low = cells.filter(F.col("v") < threshold)
    low = openings.opened_cells(cells, rasters, threshold, min_width / 2) if min_width else low
    lab = labelled(low, rasters, connectivity).join(low, list(KEY)).join(rasters.select("raster_id", "nrows", "ncols", "xll", "yll", "cellsize"), "raster_id")
    cs = F.col("cellsize")
    if min_width:
        border = border_reaching(cells, rasters, threshold, connectivity).withColumn("edge", F.lit(True))
        lab = lab.join(border, list(KEY), "left").withColumn("edge", F.coalesce("edge", F.lit(False)))
    else:
        lab = lab.withColumn("edge", (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("nrows") - 1) | (F.col("col") == F.col("ncols") - 1))
    out = lab.groupBy("raster_id", "label").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * F.first(cs * cs)).alias("area"), F.avg(F.col("xll") + (F.col("col") + 0.5) * cs).alias("centroid_x"), F.avg(F.col("yll") + (F.col("nrows") - F.col("row") - 0.5) * cs).alias("centroid_y"), F.avg("v").alias("mean_height"), F.max("v").alias("max_height"), F.bool_or("edge").alias("touches_edge"))
    out = out.filter(F.col("area") >= min_area)
    out = out if include_edge else out.filter("NOT touches_edge")
    if with_width:
        wide = openings.widths(lab.join(out, ["raster_id", "label"], "left_semi")).join(rasters.select("raster_id", "cellsize"), "raster_id")
        out = out.join(wide.select("raster_id", "label", (2 * F.col("radius") * cs).alias("width")), ["raster_id", "label"])
    return out.withColumn("gap_id", F.row_number().over(Window.partitionBy("raster_id").orderBy(F.desc("area"), "label"))).drop("label")


def treetop_candidates(cells: DataFrame, rasters: DataFrame, min_height: float = 2.0, base: float = 0.8, slope: float = 0.055) -> DataFrame:
    """Cells of ``min_height`` or more without a strictly higher valid cell within their own search radius.

    A cell that is lower than the maximum of its own 3 x 3 neighbours within reach falls out first, by a
    scatter; the few local maxima left look for higher cells by an equi-join on the cells in reach.
    """
    v = valid(cells).join(rasters.select("raster_id", "cellsize", "nrows", "ncols"), "raster_id")
    radius = (base + slope * F.greatest("v", F.lit(0.0))) / F.col("cellsize")
    tops = v.filter(F.col("v") >= min_height).withColumn("radius", F.least(radius, (F.col("nrows") + F.col("ncols")).cast("double")))
    # Most cells have a higher one beside them: those fall out before anything of the size of a window is made.
    beside = moved(cells, FOUR).groupBy(*KEY).agg(F.max("w").alias("w4"))
    around = moved(cells, EIGHT).groupBy(*KEY).agg(F.max("w").alias("w8"))
    tops = tops.join(beside, list(KEY), "left").join(around, list(KEY), "left")
    taller = lambda w, least: (F.col("radius") >= least) & (F.coalesce(F.col(w), F.lit(float("-inf"))) > F.col("v"))
    tops = tops.filter(~(taller("w4", 1.0) | taller("w8", 2.0**0.5))).drop("w4", "w8")
    # A higher cell is at most the reach of the lower one away, and only whole offsets within it matter.
    reach = F.floor("radius").cast("int")
    rows = tops.select(*KEY, "v", "radius", F.explode(F.sequence(-reach, reach)).alias("dr"))
    span = F.floor(F.sqrt(F.greatest(F.col("radius") ** 2 - F.col("dr") ** 2, F.lit(0.0)))).cast("int")
    probes = rows.select(*KEY, "v", (F.col("row") + F.col("dr")).alias("r"), F.explode(F.sequence(F.col("col") - span, F.col("col") + span)).alias("c"))
    high = valid(cells).select("raster_id", F.col("row").alias("r"), F.col("col").alias("c"), F.col("v").alias("w"))
    beaten = probes.join(high, ["raster_id", "r", "c"]).filter("w > v").select(*KEY).distinct()
    return tops.select(*KEY, "v").join(beaten, list(KEY), "left_anti")


def ascii_rows(cells: DataFrame, ramp: str = " .:-=+*#%@&") -> DataFrame:
    """A line of characters for each row, low to high."""
    span = F.nullif(F.max("v").over(Window.partitionBy("raster_id")) - F.min("v").over(Window.partitionBy("raster_id")), F.lit(0.0))
    low = F.min("v").over(Window.partitionBy("raster_id"))
    k = F.least(F.lit(len(ramp) - 1), F.floor((F.col("v") - low) / span * len(ramp))).cast("int")
    c = F.when(F.col("v").isNull(), F.lit("?")).otherwise(F.substring(F.lit(ramp), F.coalesce(k, F.lit(0)) + 1, F.lit(1)))
    lines = cells.select("raster_id", "row", F.struct("col", c.alias("c")).alias("s")).groupBy("raster_id", "row").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lines.select("raster_id", "row", F.array_join(F.transform("s", lambda s: s.c), "").alias("line"))
