"""Height-diameter curves fitted by least squares: a simplex search in each group of stems."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groveline.functions.curves import CURVES, default_params
from groveline.operators import inventory as inv

FAMILY = "naslund"
MODEL = "species string, family string, params array<double>, n long, rmse double, r2 double, converged boolean"


@dataclass(frozen=True)
class Minimum:
    x: tuple[float, ...]
    value: float
    rounds: int
    converged: bool


def simplex(f: Callable[[np.ndarray], float], start: Sequence[float], step: float = 0.25, rounds: int = 4000, tolerance: float = 1e-10) -> Minimum:
    """Downhill simplex (Nelder and Mead, 1965): reflect, expand, contract, shrink; a value that isn't finite counts as infinite."""

    def cost(x: np.ndarray) -> float:
        try:
            v = float(f(x))
        except (ArithmeticError, ValueError):
            return math.inf
        return v if math.isfinite(v) else math.inf

    start = np.asarray(start, float)
    points = np.vstack([start, start + np.diag(np.where(start != 0, np.abs(start) * step, step))])
    values = np.array([cost(p) for p in points])
    for k in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tolerance * (1 + abs(values[0])) and np.abs(points[1:] - points[0]).max() <= tolerance * (1 + np.abs(points[0]).max()):
            return Minimum(tuple(points[0]), values[0], k, True)
        centre = points[:-1].mean(0)
        away = centre - points[-1]
        reflected = cost(centre + away)
        if reflected < values[0]:
            far = cost(centre + 2 * away)
            points[-1], values[-1] = (centre + 2 * away, far) if far < reflected else (centre + away, reflected)
        elif reflected < values[-2]:
            points[-1], values[-1] = centre + away, reflected
        else:
            side = 0.5 if reflected < values[-1] else -0.5
            inner = cost(centre + side * away)
            if inner < min(reflected, values[-1]):
                points[-1], values[-1] = centre + side * away, inner
            else:
                points[1:] = (points[0] + points[1:]) / 2
                values[1:] = [cost(p) for p in points[1:]]
    best = int(values.argmin())
    return Minimum(tuple(points[best]), values[best], rounds, False)


def fit_pairs(dbh: np.ndarray, height: np.ndarray, family: str = FAMILY, least: int = 6) -> dict:
    """Parameters and statistics of one family for pairs of positive values; the order of the pairs doesn't matter."""
    if family not in CURVES:
        raise ValueError(f"unknown curve family {family!r}; there are {sorted(CURVES)}")
    if least < 1 or len(dbh) < max(least, 1):
        raise ValueError(f"{len(dbh)} pairs are fewer than {least}")
    order = np.lexsort((height, dbh))
    d, h = np.asarray(dbh, float)[order], np.asarray(height, float)[order]
    curve = CURVES[family]

    def sse(p: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            return float(((h - curve.array(d, p)) ** 2).sum())

    best = simplex(sse, curve.start)
    again = simplex(sse, best.x, step=0.02)
    best = again if again.value <= best.value else best
    total = float(((h - h.mean()) ** 2).sum())
    return {"family": family, "params": list(best.x), "n": len(d), "rmse": math.sqrt(best.value / len(d)), "r2": 1 - best.value / total if total > 0 else 0.0, "converged": best.converged}


def fit_by_species(trees: DataFrame, family: str = FAMILY, least: int = 8) -> DataFrame:
    """plot_id and a curve for each species with ``least`` live pairs, and for all stems of a plot under species ''.

    A plot with too few pairs in all gets the tabulated curve of the species that has most of them (n 0,
    no statistics), whatever the family. Each (plot, species) is a task of its own: pooled stems are
    a second, coarser grouping of the same scan.
    """
    if family not in CURVES:
        raise ValueError(f"unknown curve family {family!r}; there are {sorted(CURVES)}")
    key = trees.schema["plot_id"].dataType.simpleString()
    code = F.coalesce(F.upper(F.trim("species")), F.lit(""))
    pairs = inv.paired(trees).select("plot_id", code.alias("code"), "dbh_cm", "height_m")
    groups = pairs.withColumn("species", F.explode(F.array_distinct(F.array(F.lit(""), "code"))))
    sizes = groups.groupBy("plot_id", "species").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"plot_id": part["plot_id"].iat[0], "species": part["species"].iat[0]} | fit_pairs(part["dbh_cm"].to_numpy(), part["height_m"].to_numpy(), family, least)])

    fitted = groups.join(sizes, ["plot_id", "species"], "left_semi").groupBy("plot_id", "species").applyInPandas(fit, f"plot_id {key}, {MODEL}")
    counts = trees.select("plot_id", code.alias("code"), F.when(inv.is_live() & (F.col("dbh_cm") > 0) & (F.col("height_m") > 0), 1).otherwise(0).alias("pair")).groupBy("plot_id", "code").agg(F.sum("pair").alias("n"))
    most = counts.withColumn("all", F.sum("n").over(Window.partitionBy("plot_id"))).withColumn("k", F.row_number().over(Window.partitionBy("plot_id").orderBy(F.desc("n"), "code"))).filter((F.col("k") == 1) & (F.col("all") < least))
    return fitted.unionByName(most.select("plot_id", F.lit("").alias("species"), *default_model(F.col("code"))))


def default_model(species: Column) -> list[Column]:
    """Columns of the tabulated curve of a species code, marked by n 0."""
    null = F.lit(None).cast("double")
    return [F.lit(FAMILY).alias("family"), default_params(species).alias("params"), F.lit(0).cast("long").alias("n"), null.alias("rmse"), null.alias("r2"), F.lit(True).alias("converged")]


def with_curves(trees: DataFrame, models: DataFrame) -> DataFrame:
    """Add ``curve`` (the species it was fitted on), family and params to each stem: its species' curve, else the plot's pooled one."""
    code = F.coalesce(F.upper(F.trim("species")), F.lit(""))
    own = models.select("plot_id", F.col("species").alias("_code"), F.struct(F.col("species").alias("curve"), "family", "params").alias("_own"))
    pooled = models.filter("species = ''").select("plot_id", F.struct(F.col("species").alias("curve"), "family", "params").alias("_all"))
    joined = trees.withColumn("_code", code).join(own, ["plot_id", "_code"], "left").join(pooled, "plot_id", "left").withColumn("_m", F.coalesce("_own", "_all"))
    return joined.select(*(F.col(c) for c in trees.columns), "_m.curve", "_m.family", "_m.params")


def predicted(dbh: str = "dbh_cm") -> Column:
    """Height by the row's family and params."""
    out = F.lit(None).cast("double")
    for name, curve in CURVES.items():
        value = curve.column(F.col(dbh), [F.col("params")[i] for i in range(len(curve.start))])
        out = F.when(F.col("family") == name, value).otherwise(out)
    return out


def model_rows(models: DataFrame) -> DataFrame:
    """Models as reports print them: parameters to six places, statistics to four."""
    return models.withColumn("params", F.transform("params", lambda p: F.round(p, 6))).withColumn("rmse", F.round("rmse", 4)).withColumn("r2", F.round("r2", 4))

