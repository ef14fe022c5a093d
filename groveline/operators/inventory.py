"""Stand mensuration: filters, totals, ranks and diversity by plot, all in one shuffle where Catalyst can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Status codes of a live stem.
LIVE = ("live", "living", "alive", "l", "1")
FORM_FACTOR, SDI_EXPONENT, SDI_DIAMETER = 0.5, 1.605, 25.0
# Wood density by species code, and of any other.
DENSITY = {"PIAB": 0.40, "PISY": 0.42, "FASY": 0.58, "QURO": 0.56, "PSME": 0.45, "BEPE": 0.52}
OTHER_DENSITY = 0.5


def is_live() -> Column:
    return F.lower(F.trim("status")).isin(*LIVE)


def live(trees: DataFrame) -> DataFrame:
    return trees.filter(is_live())


def is_measured() -> Column:
    return F.col("dbh_cm") > 0


def measured(trees: DataFrame) -> DataFrame:
    return trees.filter(is_measured())


def paired(trees: DataFrame, live_only: bool = True) -> DataFrame:
    """Diameter and height pairs, both positive."""
    return (live(trees) if live_only else trees).filter(is_measured() & (F.col("height_m") > 0))


def shifted(trees: DataFrame, dx: float, dy: float) -> DataFrame:
    return trees.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def stem_basal_area() -> Column:
    return F.when(is_measured(), F.pi() * F.pow(F.col("dbh_cm") / 200, F.lit(2.0)))


def _both() -> Column:
    return is_measured() & (F.col("height_m") > 0)


def stem_volume(form_factor: float = FORM_FACTOR) -> Column:
    return F.when(_both(), form_factor * stem_basal_area() * F.col("height_m"))


def wood_density(densities: dict[str, float] = DENSITY, other: float = OTHER_DENSITY) -> Column:
    code, out = F.upper(F.trim("species")), F.lit(other)
    for k, v in densities.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def stem_biomass(densities: dict[str, float] = DENSITY) -> Column:
    """Kilograms above ground."""
    return F.when(_both(), 0.0673 * F.pow(wood_density(densities) * F.col("dbh_cm") ** 2 * F.col("height_m"), F.lit(0.976)))


def basal_area(trees: DataFrame) -> DataFrame:
    return live(trees).groupBy("plot_id").agg(F.sum(stem_basal_area()).alias("basal_area_m2"))


def _qmd() -> Column:
    return F.sqrt(F.avg(F.when(is_measured(), F.col("dbh_cm") ** 2)))


def quadratic_mean_diameter(trees: DataFrame) -> DataFrame:
    return live(trees).groupBy("plot_id").agg(_qmd().alias("qmd_cm"))


def _lorey() -> Column:
    w = F.when(_both(), F.col("dbh_cm") ** 2)
    return F.try_divide(F.sum(w * F.col("height_m")), F.sum(w))


def lorey_height(trees: DataFrame) -> DataFrame:
    return live(trees).groupBy("plot_id").agg(_lorey().alias("lorey_height_m"))


def top_count(area: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(100 * area + 0.5))


def dominant_height(trees: DataFrame, plots: DataFrame) -> DataFrame:
    """Mean height of the 100 thickest stems a hectare; ties by diameter, height, id. Rank and filter push a group limit."""
    w = Window.partitionBy("plot_id").orderBy(F.desc("dbh_cm"), F.desc("height_m"), "tree_id")
    ranked = paired(trees).select("plot_id", "tree_id", "dbh_cm", "height_m").withColumn("rank", F.row_number().over(w))
    return ranked.join(plots, "plot_id").filter(F.col("rank") <= top_count(F.col("area_ha"))).groupBy("plot_id").agg(F.avg("height_m").alias("dominant_height_m"))


def gini(trees: DataFrame) -> DataFrame:
    """Inequality of basal area, in 0..1; null for fewer than two stems, 0 if all are zero."""
    v = measured(live(trees)).select("plot_id", stem_basal_area().alias("v"))
    ranked = v.withColumn("i", F.row_number().over(Window.partitionBy("plot_id").orderBy("v")))
    n, total = F.count(F.lit(1)), F.sum("v")
    g = 2 * F.sum(F.col("i") * F.col("v")) / (n * F.nullif(total, F.lit(0.0))) - (n + 1) / n
    return ranked.groupBy("plot_id").agg(F.when((n >= 2) & (total > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), g))).when(n >= 2, 0.0).alias("gini"))


def species_composition(trees: DataFrame) -> DataFrame:
    code = F.upper(F.trim("species"))
    counts = live(trees).filter(code != "").groupBy("plot_id", code.alias("species")).agg(F.count(F.lit(1)).alias("stems"))
    return counts.withColumn("share", F.col("stems") / F.sum("stems").over(Window.partitionBy("plot_id")))


def diversity(trees: DataFrame) -> DataFrame:
    s = F.col("share")
    shares = F.array_sort(F.collect_list(F.struct((-s).alias("k"), "species", "share")))
    return species_composition(trees).groupBy("plot_id").agg((-F.sum(s * F.log(s))).alias("shannon"), (1 - F.sum(s * s)).alias("simpson"), F.transform(shares, lambda x: F.struct(x.species.alias("species"), x.share.alias("share"))).alias("species_shares"))


def diameter_distribution(trees: DataFrame, class_width: float = 5.0) -> DataFrame:
    """Stems by diameter class; the class number is a division of decimals, as the values are written."""
    if not 1e-3 <= class_width < float("inf"):
        raise ValueError("class_width must be finite and at least 0.001 cm")
    width = F.lit(str(class_width)).cast("decimal(20,6)")
    number = F.floor(F.col("dbh_cm").cast("string").cast("decimal(20,6)") / width).cast("long")
    text = lambda k: F.regexp_replace(F.regexp_replace((k.cast("decimal(20,0)") * width).cast("decimal(32,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    counts = measured(live(trees)).groupBy("plot_id", number.alias("band")).agg(F.count(F.lit(1)).alias("stems"))
    return counts.select("plot_id", "band", F.concat_ws("-", text(F.col("band")), text(F.col("band") + 1)).alias("label"), "stems")


def yields(trees: DataFrame, densities: dict[str, float] = DENSITY) -> DataFrame:
    return live(trees).groupBy("plot_id").agg(F.count(stem_volume()).alias("yield_basis_count"), F.sum(stem_volume()).alias("volume_m3"), (F.sum(stem_biomass(densities)) / 1000).alias("biomass_t"))


def stand_metrics(trees: DataFrame, plots: DataFrame, form_factor: float = FORM_FACTOR) -> DataFrame:
    """The stand summary, a row for each plot; unknown is null and differs from zero."""
    area = F.col("area_ha")
    h = F.when(F.col("height_m") > 0, F.col("height_m"))
    one = live(trees).groupBy("plot_id").agg(
        F.count(F.lit(1)).alias("tree_count"), F.count_if(is_measured()).alias("measured_count"), F.count(stem_volume()).alias("yield_basis_count"), F.sum(stem_basal_area()).alias("_g"),
        _qmd().alias("qmd_cm"), F.avg(F.when(is_measured(), F.col("dbh_cm"))).alias("mean_dbh_cm"), F.avg(h).alias("mean_height_m"), _lorey().alias("lorey_height_m"), F.max(h).alias("max_height_m"),
        F.sum(stem_volume(form_factor)).alias("_v"), F.sum(stem_biomass()).alias("_b"))
    out = plots.join(one, "plot_id", "left").join(dominant_height(trees, plots), "plot_id", "left").join(gini(trees), "plot_id", "left").join(diversity(trees).drop("species_shares"), "plot_id", "left")
    stems = F.coalesce("tree_count", F.lit(0)) / area
    return out.select(
        "plot_id", "area_ha", F.coalesce("tree_count", F.lit(0)).alias("tree_count"), F.coalesce("measured_count", F.lit(0)).alias("measured_count"), F.coalesce("yield_basis_count", F.lit(0)).alias("yield_basis_count"),
        stems.alias("stems_per_ha"), (F.col("_g") / area).alias("basal_area_per_ha"), "qmd_cm", "mean_dbh_cm", "mean_height_m", "lorey_height_m", "dominant_height_m", "max_height_m",
        (stems * F.pow(F.col("qmd_cm") / SDI_DIAMETER, F.lit(SDI_EXPONENT))).alias("sdi"), F.col("gini").alias("gini_basal_area"), "shannon", "simpson", (F.col("_v") / area).alias("volume_per_ha_m3"), (F.col("_b") / 1000 / area).alias("biomass_per_ha_t"))


def generated_ids(trees: DataFrame, order: str, prefix: str = "") -> DataFrame:
    """Fill blank ids with the least whole numbers that no record has (compared as text)."""
    blank = F.coalesce(F.trim("tree_id"), F.lit("")) == ""
    missing = trees.filter(blank).withColumn("_k", F.row_number().over(Window.partitionBy("plot_id").orderBy(order)))
    need = missing.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n"))
    have = trees.filter(~blank).select("plot_id", F.trim("tree_id").alias("tree_id")).distinct()
    total = need.join(have.groupBy("plot_id").agg(F.count(F.lit(1)).alias("h")), "plot_id", "left")
    free = total.select("plot_id", F.explode(F.sequence(F.lit(1), (F.col("n") + F.coalesce("h", F.lit(0))).cast("int"))).alias("i")).withColumn("tree_id", F.concat(F.lit(prefix), F.col("i").cast("string")))
    free = free.join(have, ["plot_id", "tree_id"], "left_anti").withColumn("_k", F.row_number().over(Window.partitionBy("plot_id").orderBy("i"))).select("plot_id", "_k", F.col("tree_id").alias("_id"))
    filled = missing.join(free, ["plot_id", "_k"]).withColumn("tree_id", F.col("_id")).select(*trees.columns)
    return trees.filter(~blank).unionByName(filled)
