"""Inspection rules: each turns the context into rows of one schema; their union is the inspection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.functions import fitting
from groveline.functions.curves import default_params, leave_one_out
from groveline.operators import inventory as inv
from groveline.operators import raster
from groveline.plans.profile import Profile
from groveline.session import cut

INFO, NOTICE, WARNING, CRITICAL = range(4)
SEVERITIES = ("info", "notice", "warning", "critical")
RULES: list[Callable[[Context], list[DataFrame]]] = []


def severity(text: str) -> int:
    if text.strip().lower() not in SEVERITIES:
        raise ValueError(f"unknown severity {text!r}")
    return SEVERITIES.index(text.strip().lower())


@dataclass
class Context:
    """What rules may see. Frames are built once and lazily; absent inputs are None and their rules stay silent."""

    trees: DataFrame | None
    plots: DataFrame
    extent: DataFrame | None = None  # xmin, ymin, xmax, ymax: one row, or with plot_id a row for each plot
    profile: Profile = field(default_factory=Profile)
    metrics: DataFrame | None = None  # from trees unless given
    cells: DataFrame | None = None  # canopy heights; raster_id is the plot's plot_id
    rasters: DataFrame | None = None  # headers of cells
    match: DataFrame | None = None  # of matching.match_summary

    models: DataFrame | None = None  # curves of the stems, fitted from trees unless given

    def __post_init__(self) -> None:
        if self.metrics is None and self.trees is not None:
            self.metrics = cut(inv.stand_metrics(self.trees, self.plots))  # a row for each plot, which six rules read

    def curves(self) -> DataFrame:
        if self.models is None:
            self.models = cut(fitting.fit_by_species(self.trees, least=int(self.profile.min_allometry_points)))
        return self.models


def rule(f):
    """Add a rule; rules run in the order in which they are added."""
    RULES.append(f)
    return f


def finding(df: DataFrame, code: str, level: Column | int, title: str, subject: Column | None = None, value: Column | None = None, threshold: float | None = None) -> DataFrame:
    level = F.lit(level) if isinstance(level, int) else level
    null = F.lit(None)
    return df.select("plot_id", F.lit(code).alias("code"), level.cast("int").alias("severity"), F.lit(title).alias("title"), (subject if subject is not None else F.lit("stand")).alias("subject"),
                     (value if value is not None else null).cast("double").alias("value"), (F.lit(threshold) if threshold is not None else null).cast("double").alias("threshold"))


def _limits(ctx: Context, name: str, low: tuple | None, high: tuple | None) -> list[DataFrame]:
    v, out = F.col(name), []
    if low:
        out.append(finding(ctx.metrics.filter(v < low[3]), *low[:3], value=v, threshold=low[3]))
    if high:
        out.append(finding(ctx.metrics.filter(v > high[3]), *high[:3], value=v, threshold=high[3]))
    return out


@rule
def stocking(ctx):
    p = ctx.profile
    return _limits(ctx, "stems_per_ha", ("SV001", WARNING, "Understocked stand", p.min_stems_per_ha), ("SV002", NOTICE, "Overstocked stand", p.max_stems_per_ha)) if ctx.metrics is not None else []


@rule
def density_index(ctx):
    p = ctx.profile
    return _limits(ctx, "sdi", ("SV003", NOTICE, "Low stand density index", p.min_sdi), ("SV004", WARNING, "High stand density index", p.max_sdi)) if ctx.metrics is not None else []


def _by_plot(ctx: Context, df: DataFrame) -> DataFrame:
    return df.withColumn("plot_id", F.col("raster_id").cast(ctx.plots.schema["plot_id"].dataType))


def _canopy(ctx: Context) -> DataFrame:
    """Cover and gap fraction of each raster with an observed cell."""
    return _by_plot(ctx, raster.canopy(raster.valid(ctx.cells), ctx.profile.canopy_threshold))


@rule
def canopy_cover(ctx):
    if ctx.cells is None:
        return []
    low, v = ctx.profile.min_canopy_cover, F.col("cover")
    return [finding(_canopy(ctx).filter(v < low), "SV010", WARNING, "Canopy cover below target", value=v, threshold=low)]


@rule
def large_gaps(ctx):
    if ctx.cells is None or ctx.rasters is None:
        return []
    p, v = ctx.profile, F.col("area")
    found = raster.gaps(ctx.cells, ctx.rasters, p.canopy_threshold, p.min_gap_area, min_width=p.min_gap_width)
    level = F.when(F.col("touches_edge"), WARNING).otherwise(CRITICAL)
    return [finding(_by_plot(ctx, found).filter(v > p.max_gap_area), "SV011", level, "Large canopy gap", F.concat(F.lit("gap:"), F.col("gap_id")), v, p.max_gap_area)]


@rule
def gap_fraction(ctx):
    if ctx.cells is None:
        return []
    high, v = ctx.profile.max_gap_fraction, F.col("gap_fraction")
    return [finding(_canopy(ctx).filter(v > high), "SV012", NOTICE, "High open-canopy fraction", value=v, threshold=high)]


@rule
def structural_diversity(ctx):
    return _limits(ctx, "gini_basal_area", ("SV020", NOTICE, "Uniform stem sizes", ctx.profile.min_gini), None) if ctx.trees is not None else []


@rule
def species_diversity(ctx):
    if ctx.trees is None:
        return []
    shares = inv.species_composition(ctx.trees).filter(F.col("share") > ctx.profile.max_species_share)
    return [*_limits(ctx, "shannon", ("SV021", NOTICE, "Low species diversity", ctx.profile.min_shannon), None),
            finding(shares, "SV022", NOTICE, "Single-species dominance", F.concat(F.lit("species:"), F.col("species")), F.col("share"), ctx.profile.max_species_share)]


def _tree() -> Column:
    return F.concat(F.lit("tree:"), F.col("tree_id"))


@rule
def height_anomalies(ctx):
    """Residuals against the species' fitted curve, else the plot's, scored against the others of the plot and curve."""
    if ctx.trees is None:
        return []
    limit = ctx.profile.height_residual_z
    z = fitted_residuals(ctx.trees, ctx.curves()).filter(F.abs("z") > limit)
    return [finding(z, "SV030", F.when(F.abs("z") >= limit + 1, WARNING).otherwise(NOTICE), "Height-diameter outlier", _tree(), F.abs("z"), limit)]


def height_residuals(trees: DataFrame) -> DataFrame:
    pairs = inv.paired(trees).withColumn("params", default_params(F.col("species")))
    d, p = F.col("dbh_cm"), F.col("params")
    predicted = 1.3 + F.pow(d / (p[0] + p[1] * d), F.lit(2.0))
    scored = pairs.withColumn("residual", F.col("height_m") - predicted).withColumn("curve", p[0])
    return leave_one_out(scored, "residual", ["plot_id", "curve"], ["tree_id", "residual", "x", "y"]).drop("curve", "params")


def fitted_residuals(trees: DataFrame, models: DataFrame) -> DataFrame:
    """Live pairs with ``residual`` and its score ``z`` among the stems that share a curve in their plot."""
    pairs = fitting.with_curves(inv.paired(trees), models).withColumn("residual", F.col("height_m") - fitting.predicted())
    return leave_one_out(pairs, "residual", ["plot_id", "curve"], ["tree_id", "residual", "x", "y"]).drop("curve", "family", "params")


@rule
def dbh_outliers(ctx):
    if ctx.trees is None:
        return []
    z = dbh_scores(ctx.trees).filter((F.col("n") >= 5) & (F.abs("z") > ctx.profile.dbh_outlier_z))
    return [finding(z, "SV031", NOTICE, "Diameter outlier", _tree(), F.abs("z"), ctx.profile.dbh_outlier_z)]


def dbh_scores(trees: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    scored = leave_one_out(inv.measured(inv.live(trees)), "dbh_cm", ["plot_id"], ["tree_id", "dbh_cm", "x", "y"])
    return scored.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("plot_id")))


@rule
def missing_measurements(ctx):
    if ctx.trees is None:
        return []
    return [finding(inv.live(ctx.trees).filter("dbh_cm IS NULL OR height_m IS NULL"), "SV040", NOTICE, "Missing measurement", _tree())]


@rule
def duplicate_ids(ctx):
    if ctx.trees is None:
        return []
    n = ctx.trees.groupBy("plot_id", "tree_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return [finding(n, "SV041", CRITICAL, "Duplicate tree identifier", _tree(), F.col("n"), 1.0)]


@rule
def implausible_dimensions(ctx):
    if ctx.trees is None:
        return []
    p, d, h = ctx.profile, F.col("dbh_cm"), F.col("height_m")
    bad = ctx.trees.filter((d <= 0) | (h <= 0) | (d > p.max_plausible_dbh_cm) | (h > p.max_plausible_height_m))
    return [finding(bad, "SV042", CRITICAL, "Implausible dimension", _tree())]


@rule
def coordinates_in_extent(ctx):
    if ctx.trees is None or ctx.extent is None:
        return []
    x, y = F.col("x"), F.col("y")
    trees, sides = ctx.trees.select("plot_id", "tree_id", "x", "y"), ("xmin", "ymin", "xmax", "ymax")
    if "plot_id" in ctx.extent.columns:
        held = trees.join(ctx.extent.select("plot_id", *sides), "plot_id")
    else:  # one for all; several are an error
        many = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several extents need a plot_id")).cast("double"))
        held = trees.crossJoin(F.broadcast(ctx.extent.agg(*(F.coalesce(many, F.max(c)).alias(c) for c in sides))))
    out = held.filter(~(x.between(F.col("xmin"), F.col("xmax")) & y.between(F.col("ymin"), F.col("ymax"))))
    return [finding(out, "SV043", WARNING, "Coordinate outside raster extent", _tree())]


@rule
def detection_agreement(ctx):
    """An undefined recall, precision or bias is silent."""
    if ctx.match is None:
        return []
    p, subject, bias = ctx.profile, F.lit("detection"), F.abs("height_bias_m")
    below = lambda name, code, title, low: finding(ctx.match.filter(F.col(name) < low), code, WARNING, title, subject, F.col(name), low)
    return [below("recall", "SV050", "Low detection recall", p.min_recall), below("precision", "SV051", "Low detection precision", p.min_precision),
            finding(ctx.match.filter(bias > p.max_height_bias_m), "SV052", WARNING, "Systematic height bias", subject, bias, p.max_height_bias_m)]


def inspect(ctx: Context, rules=None) -> DataFrame:
    """All findings; order them by severity (down), code and subject to print."""
    parts = [df for r in (rules or RULES) for df in r(ctx)]
    return reduce(DataFrame.unionByName, parts)


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("plot_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


def worst(findings: DataFrame) -> DataFrame:
    """The highest severity of each plot that has findings."""
    return findings.groupBy("plot_id").agg(F.max("severity").alias("severity"))


def at_or_above(findings: DataFrame, level: str | int) -> DataFrame:
    return findings.filter(F.col("severity") >= (severity(level) if isinstance(level, str) else level))
