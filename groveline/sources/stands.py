"""Made-up stands with known trees: seeded positions, sizes and crowns, painted into a canopy raster."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.functions.curves import CURVES, DEFAULTS


@dataclass(frozen=True)
class Stand:
    """Size in metres, density, and what trees, crowns and gaps are drawn from. The defaults."""

    width: float = 100.0
    height: float = 100.0
    cellsize: float = 0.5
    stems_per_ha: float = 320.0
    species: tuple[str, ...] = ("PIAB", "FASY", "BEPE")
    weights: tuple[float, ...] = (0.6, 0.3, 0.1)
    dbh_mean: float = 28.0
    dbh_spread: float = 0.32
    dbh_least: float = 8.0
    dbh_most: float = 85.0
    height_noise: float = 0.04
    crown_base: float = 0.9
    crown_slope: float = 0.085
    surface_noise: float = 0.05
    gaps: int = 2
    gap_radius: tuple[float, float] = (5.0, 9.0)
    terrain_slope: float = 0.03
    terrain_relief: float = 1.5

    def __post_init__(self) -> None:
        if min(self.width, self.height, self.cellsize) <= 0 or self.stems_per_ha < 0 or len(self.species) != len(self.weights) or sum(self.weights) <= 0:
            raise ValueError("a stand needs positive sizes, and a weight for each species")


TREES = "plot_id string, tree_id string, species string, status string, dbh_cm double, height_m double, crown_diameter_m double, x double, y double"


def _stems(stand: Stand, rng: np.random.Generator) -> pd.DataFrame:
    """Stems no nearer to each other than a spacing that goes with the density, and none in a gap."""
    want, spacing = round(stand.stems_per_ha * stand.width * stand.height / 10_000), 0.62 * math.sqrt(10_000 / max(stand.stems_per_ha, 1))
    holes = []
    for _ in range(stand.gaps):
        r = rng.uniform(*stand.gap_radius)
        holes.append((rng.uniform(r, max(r, stand.width - r)), rng.uniform(r, max(r, stand.height - r)), r))
    buckets: dict[tuple[int, int], list[tuple[float, float]]] = {}
    found: list[tuple[float, float]] = []
    for x, y in rng.uniform((0, 0), (stand.width, stand.height), (want * 80, 2)):
        if len(found) == want:
            break
        i, j = int(x // spacing), int(y // spacing)
        near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in buckets.get((i + a, j + b), ()))
        if all(math.hypot(x - a, y - b) >= r for a, b, r in holes) and all(math.hypot(x - a, y - b) >= spacing for a, b in near):
            found.append((x, y))
            buckets.setdefault((i, j), []).append((x, y))
    n = len(found)
    species = rng.choice(stand.species, n, p=np.array(stand.weights) / sum(stand.weights))
    dbh = np.clip(np.exp(rng.normal(math.log(stand.dbh_mean), stand.dbh_spread, n)), stand.dbh_least, stand.dbh_most)
    tall = np.array([CURVES["naslund"].array(d, DEFAULTS.get(s, DEFAULTS[""])) for d, s in zip(dbh, species, strict=True)]) * (1 + rng.normal(0, stand.height_noise, n))
    tall = np.maximum(tall, 2.5)
    crown = 2 * (stand.crown_base + stand.crown_slope * tall) * rng.uniform(0.88, 1.12, n)
    return pd.DataFrame({"tree_id": [f"T{k + 1:04d}" for k in range(n)], "species": species, "status": "live", "dbh_cm": dbh.round(1), "height_m": tall.round(2), "crown_diameter_m": crown.round(2), "x": [p[0] for p in found], "y": [p[1] for p in found]})


def paint(trees: pd.DataFrame, stand: Stand, rng: np.random.Generator) -> np.ndarray:
    """Canopy heights, north row first: each crown is a paraboloid, the highest one shows."""
    rows, cols, cs = math.ceil(stand.height / stand.cellsize), math.ceil(stand.width / stand.cellsize), stand.cellsize
    out = np.zeros((rows, cols))
    for x, y, h, d in zip(trees["x"], trees["y"], trees["height_m"], trees["crown_diameter_m"], strict=True):
        r = max(d / 2, 0.75 * cs)  # no crown slips between cell centres
        at, span = (rows - y / cs, x / cs), int(r / cs) + 2
        a, b = max(int(at[0]) - span, 0), max(int(at[1]) - span, 0)
        part = out[a : int(at[0]) + span, b : int(at[1]) + span]
        far = ((np.arange(a, a + part.shape[0])[:, None] + 0.5 - at[0]) ** 2 + (np.arange(b, b + part.shape[1])[None] + 0.5 - at[1]) ** 2) * cs * cs
        np.maximum(part, np.where(far <= r * r, h * (1 - far / (r * r)), 0), out=part)
    return np.maximum(out + rng.normal(0, stand.surface_noise, out.shape), 0)


def synthesize(spark: SparkSession, seeds: list[int], stand: Stand = Stand()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trees, rasters, cells) of one stand for each seed; cells have ``v`` (canopy), ``ground`` and ``surface``. A stand is a task."""
    plots = spark.createDataFrame([(f"stand-{s}", s) for s in seeds], "plot_id string, seed long").repartition(len(seeds), "plot_id")

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for plot, seed in zip(batch["plot_id"], batch["seed"], strict=True):
                yield _stems(stand, np.random.default_rng([seed, 0])).assign(plot_id=plot)[[c.split()[0] for c in TREES.split(", ")]]

    def canopy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for plot, seed in zip(batch["plot_id"], batch["seed"], strict=True):
                v = paint(_stems(stand, np.random.default_rng([seed, 0])), stand, np.random.default_rng([seed, 1]))
                r, c = (a.ravel() for a in np.indices(v.shape))
                x, y = (c + 0.5) * stand.cellsize, (v.shape[0] - r - 0.5) * stand.cellsize
                ground = stand.terrain_slope * x + stand.terrain_relief * (np.sin(x / 17) * np.cos(y / 23) + 1)
                yield pd.DataFrame({"raster_id": plot, "row": r, "col": c, "v": v.ravel(), "ground": ground, "surface": ground + v.ravel()})

    rows, cols = math.ceil(stand.height / stand.cellsize), math.ceil(stand.width / stand.cellsize)
    rasters = plots.select(F.col("plot_id").alias("raster_id"), F.lit(cols).alias("ncols"), F.lit(rows).alias("nrows"), F.lit(0.0).alias("xll"), F.lit(0.0).alias("yll"), F.lit(stand.cellsize).alias("cellsize"), F.lit(-9999.0).alias("nodata"), F.lit(None).cast("string").alias("crs"))
    return plots.mapInPandas(stems, TREES), rasters, plots.mapInPandas(canopy, "raster_id string, row int, col int, v double, ground double, surface double")
