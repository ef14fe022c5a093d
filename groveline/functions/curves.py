"""Height-diameter curves as column expressions, their inverses, and leave-one-out scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BREAST_HEIGHT = 1.3
# Starting points of the curve families.
START = {"curtis": (30.0, 3.0), "naslund": (1.45, 0.178), "power": (2.0, 0.6), "chapman": (30.0, 0.04, 1.0)}
# Default curve (a, b) by species code; '' is any other.
DEFAULTS = {"PIAB": (1.300, 0.168), "PISY": (1.550, 0.185), "FASY": (1.400, 0.170), "QURO": (1.700, 0.195), "PSME": (1.200, 0.152), "BEPE": (1.600, 0.200), "": (1.450, 0.178)}


@dataclass(frozen=True)
class Curve:
    """A family: height by diameter as a Column, as numpy, and the diameter by height as a Column."""

    name: str
    start: tuple[float, ...]
    column: Callable[[Column, Sequence[Column]], Column]
    array: Callable[[np.ndarray, Sequence[float]], np.ndarray]
    inverse: Callable[[Column, Sequence[Column]], Column]


def _above(h: Column) -> Column:
    return F.when(h > BREAST_HEIGHT, h - BREAST_HEIGHT)


def _at_breast(expr: Callable[[Column, Sequence[Column]], Column], least: float = BREAST_HEIGHT):
    return lambda d, p: F.when(d <= 0, F.lit(least)).otherwise(expr(d, p))


CURVES: dict[str, Curve] = {}


def register(curve: Curve) -> None:
    CURVES[curve.name] = curve


register(Curve("curtis", START["curtis"], _at_breast(lambda d, p: BREAST_HEIGHT + p[0] * F.pow(d / (1 + d), p[1])), lambda d, p: BREAST_HEIGHT + p[0] * (d / (1 + d)) ** p[1],
               lambda h, p: (lambda q: F.when((q > 0) & (q < 1), q / (1 - q)))(F.pow(_above(h) / p[0], 1 / p[1]))))
register(Curve("naslund", START["naslund"], _at_breast(lambda d, p: BREAST_HEIGHT + F.pow(d / (p[0] + p[1] * d), F.lit(2.0))), lambda d, p: BREAST_HEIGHT + (d / (p[0] + p[1] * d)) ** 2,
               lambda h, p: (lambda s: F.when(1 - p[1] * s > 0, p[0] * s / (1 - p[1] * s)))(F.sqrt(_above(h)))))
register(Curve("power", START["power"], _at_breast(lambda d, p: p[0] * F.pow(d, p[1]), 0.0), lambda d, p: p[0] * d ** p[1], lambda h, p: F.when(h > 0, F.pow(h / p[0], 1 / p[1]))))
register(Curve("chapman", START["chapman"], _at_breast(lambda d, p: BREAST_HEIGHT + p[0] * F.pow(1 - F.exp(-p[1] * d), p[2])), lambda d, p: BREAST_HEIGHT + p[0] * (1 - np.exp(-p[1] * d)) ** p[2],
               lambda h, p: (lambda q: F.when(q < 1, -F.log(1 - q) / p[1]))(F.pow(_above(h) / p[0], 1 / p[2]))))


def height(name: str, dbh: Column, params: Sequence[float]) -> Column:
    return CURVES[name].column(dbh, [F.lit(float(p)) for p in params])


def diameter(name: str, h: Column, params: Sequence[float], low: float = 0.1, high: float = 51200.0) -> Column:
    """The diameter with that height, null outside the closed range of the curve."""
    d = CURVES[name].inverse(h, [F.lit(float(p)) for p in params])
    return F.when((d >= low) & (d <= high), d)


def default_params(species: Column) -> Column:
    code = F.upper(F.trim(species))
    out = F.array(*map(F.lit, DEFAULTS[""]))
    for k, v in DEFAULTS.items():
        if k:
            out = F.when(code == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def leave_one_out(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], name: str = "z") -> DataFrame:
    """Score of each value against the mean and deviation of the others of its group.

    Fewer than three values score 0; where the others are all equal the score is 0 or infinite.
    ``order`` must single out each row of a group.
    """
    w = Window.partitionBy(*keys)
    o = w.orderBy(*order)
    head, tail = o.rowsBetween(Window.unboundedPreceding, -1), o.rowsBetween(1, Window.unboundedFollowing)
    v = F.col(value)
    df = df.withColumn("_n", F.count(v).over(w)).withColumn("_m", F.avg(v).over(w))
    df = df.withColumn("_ss", F.sum((v - F.col("_m")) ** 2).over(w))
    df = df.withColumn("_lo", F.least(F.min(v).over(head), F.min(v).over(tail))).withColumn("_hi", F.greatest(F.max(v).over(head), F.max(v).over(tail)))
    n = F.col("_n")
    dev = (v - F.col("_m")) * n / (n - 1)
    var = (F.col("_ss") - (v - F.col("_m")) ** 2 * n / (n - 1)) / (n - 2)
    flat = F.col("_lo") == F.col("_hi")
    z = F.when(n < 3, 0.0).when(flat & (v == F.col("_lo")), 0.0).when(flat, F.when(v > F.col("_lo"), float("inf")).otherwise(float("-inf"))).otherwise(dev / F.sqrt(var))
    return df.withColumn(name, z).drop("_n", "_m", "_ss", "_lo", "_hi")
