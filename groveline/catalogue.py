"""Queries of the forest operators by name, each with the DuckDB SQL that gives the same rows.

Floating results are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline import adapters as A
from groveline.functions import curves, fitting
from groveline.operators import inventory as inv
from groveline.operators import crowns, matching, openings, raster
from groveline.plans import rules
from groveline.plans.profile import Profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

T = f"WITH t0 AS ({A.TREES_SQL}), t AS (SELECT * FROM t0 WHERE lower(trim(status)) IN ('live', 'living', 'alive', 'l', '1')), plots AS (SELECT s_suppkey AS plot_id, {A.AREA_HA}::DOUBLE AS area_ha FROM supplier) "
C = f"WITH RECURSIVE c AS (SELECT 'events' AS raster_id, row::INTEGER AS row, col::INTEGER AS col, v FROM ({A.CELLS_SQL})), v AS (SELECT * FROM c WHERE v IS NOT NULL), dim AS (SELECT max(row) + 1 AS nrows, max(col) + 1 AS ncols FROM c) "


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Six places for doubles, 64 bits for whole numbers."""
    return df.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "bigint") else F.col(c) for c, k in df.dtypes))


GINI = "SELECT plot_id, CASE WHEN count(*) >= 2 THEN coalesce(greatest(0.0, least(1.0, 2 * sum(i * v) / (count(*) * nullif(sum(v), 0)) - (count(*) + 1.0) / count(*))), 0) END AS gini FROM (SELECT plot_id, v, row_number() OVER (PARTITION BY plot_id ORDER BY v) AS i FROM (SELECT plot_id, pi() * (dbh_cm / 200) ** 2 AS v FROM t WHERE dbh_cm > 0)) GROUP BY plot_id"
DOMINANT = "SELECT plot_id, avg(height_m) AS dominant_height_m FROM (SELECT plot_id, height_m, area_ha, row_number() OVER (PARTITION BY plot_id ORDER BY dbh_cm DESC, height_m DESC, tree_id) AS k FROM t JOIN plots USING (plot_id) WHERE dbh_cm > 0 AND height_m > 0) WHERE k <= greatest(1, floor(100 * area_ha + 0.5)) GROUP BY plot_id"
SHARES = "SELECT plot_id, upper(trim(species)) AS species, count(*) AS stems, count(*) / sum(count(*)) OVER (PARTITION BY plot_id) AS share FROM t WHERE trim(species) <> '' GROUP BY plot_id, upper(trim(species))"
BIOMASS = "0.0673 * (0.5 * dbh_cm ** 2 * height_m) ** 0.976"
METRICS = f"""SELECT p.plot_id, p.area_ha, coalesce(n, 0) AS tree_count, coalesce(nm, 0) AS measured_count, coalesce(ny, 0) AS yield_basis_count, coalesce(n, 0) / p.area_ha AS stems_per_ha, g / p.area_ha AS basal_area_per_ha, qmd_cm, mean_dbh_cm, mean_height_m, lorey_height_m, dominant_height_m, max_height_m,
    coalesce(n, 0) / p.area_ha * (qmd_cm / 25) ** 1.605 AS sdi, gini AS gini_basal_area, shannon, simpson, vol / p.area_ha AS volume_per_ha_m3, bio / 1000 / p.area_ha AS biomass_per_ha_t
FROM plots p LEFT JOIN (SELECT plot_id, count(*) AS n, count(*) FILTER (dbh_cm > 0) AS nm, count(*) FILTER (dbh_cm > 0 AND height_m > 0) AS ny, sum(pi() * (dbh_cm / 200) ** 2) FILTER (dbh_cm > 0) AS g, sqrt(avg(dbh_cm ** 2) FILTER (dbh_cm > 0)) AS qmd_cm, avg(dbh_cm) FILTER (dbh_cm > 0) AS mean_dbh_cm,
    avg(height_m) FILTER (height_m > 0) AS mean_height_m, sum(dbh_cm ** 2 * height_m) FILTER (dbh_cm > 0 AND height_m > 0) / sum(dbh_cm ** 2) FILTER (dbh_cm > 0 AND height_m > 0) AS lorey_height_m, max(height_m) FILTER (height_m > 0) AS max_height_m,
    sum(0.5 * pi() * (dbh_cm / 200) ** 2 * height_m) FILTER (dbh_cm > 0 AND height_m > 0) AS vol, sum({BIOMASS}) FILTER (dbh_cm > 0 AND height_m > 0) AS bio FROM t GROUP BY plot_id) a USING (plot_id)
LEFT JOIN ({DOMINANT}) d USING (plot_id) LEFT JOIN ({GINI}) gi USING (plot_id) LEFT JOIN (SELECT plot_id, -sum(share * ln(share)) AS shannon, 1 - sum(share * share) AS simpson FROM ({SHARES}) GROUP BY plot_id) s USING (plot_id)"""
METRIC_COLUMNS = ("stems_per_ha", "basal_area_per_ha", "qmd_cm", "mean_dbh_cm", "mean_height_m", "lorey_height_m", "dominant_height_m", "max_height_m", "sdi", "gini_basal_area", "shannon", "simpson", "volume_per_ha_m3", "biomass_per_ha_t")


@query(T + "SELECT plot_id, area_ha, tree_count, measured_count, yield_basis_count, " + ", ".join(f"round({c}, 6) AS {c}" for c in METRIC_COLUMNS) + f" FROM ({METRICS})")
def stand_metrics(spark, d):
    return r6(inv.stand_metrics(A.trees(spark, d), A.plots(spark, d)))


@query(T + "SELECT tree_id, plot_id, species, round(x, 6) AS x, round(y, 6) AS y FROM t")
def live_filter(spark, d):
    return r6(inv.live(A.trees(spark, d)).select("tree_id", "plot_id", "species", "x", "y"))


@query(T + "SELECT tree_id, plot_id, dbh_cm FROM t0 WHERE dbh_cm > 0")
def measured_filter(spark, d):
    return inv.measured(A.trees(spark, d)).select("tree_id", "plot_id", "dbh_cm")


@query(T + "SELECT plot_id, dbh_cm, round(height_m, 6) AS height_m FROM t WHERE dbh_cm > 0 AND height_m > 0")
def paired_measurements(spark, d):
    return r6(inv.paired(A.trees(spark, d)).select("plot_id", "dbh_cm", "height_m"))


@query(T + "SELECT tree_id, round(x + 1.5, 6) AS x, round(y - 2.25, 6) AS y FROM t0")
def shift_trees(spark, d):
    return r6(inv.shifted(A.trees(spark, d), 1.5, -2.25).select("tree_id", "x", "y"))


@query(T + "SELECT plot_id, round(sum(pi() * (dbh_cm / 200) ** 2) FILTER (dbh_cm > 0), 6) AS basal_area_m2 FROM t GROUP BY plot_id")
def basal_area(spark, d):
    return r6(inv.basal_area(A.trees(spark, d)))


@query(T + "SELECT plot_id, round(sqrt(avg(dbh_cm ** 2) FILTER (dbh_cm > 0)), 6) AS qmd_cm FROM t GROUP BY plot_id")
def quadratic_mean_diameter(spark, d):
    return r6(inv.quadratic_mean_diameter(A.trees(spark, d)))


@query(T + "SELECT plot_id, round(sum(dbh_cm ** 2 * height_m) FILTER (dbh_cm > 0 AND height_m > 0) / sum(dbh_cm ** 2) FILTER (dbh_cm > 0 AND height_m > 0), 6) AS lorey_height_m FROM t GROUP BY plot_id")
def lorey_height(spark, d):
    return r6(inv.lorey_height(A.trees(spark, d)))


@query(T + f"SELECT plot_id, round(dominant_height_m, 6) AS dominant_height_m FROM ({DOMINANT})")
def dominant_height(spark, d):
    return r6(inv.dominant_height(A.trees(spark, d), A.plots(spark, d)))


@query(T + f"SELECT plot_id, round(sdi, 6) AS sdi FROM ({METRICS})")
def reineke_sdi(spark, d):
    return r6(inv.stand_metrics(A.trees(spark, d), A.plots(spark, d)).select("plot_id", "sdi"))


@query(T + f"SELECT plot_id, round(gini, 6) AS gini FROM ({GINI})")
def gini(spark, d):
    return r6(inv.gini(A.trees(spark, d)))


@query(T + f"SELECT plot_id, species, stems, round(share, 6) AS share FROM ({SHARES})")
def species_composition(spark, d):
    return r6(inv.species_composition(A.trees(spark, d)))


@query(T + f"SELECT plot_id, round(-sum(share * ln(share)), 6) AS shannon, round(1 - sum(share * share), 6) AS simpson FROM ({SHARES}) GROUP BY plot_id")
def shannon_simpson(spark, d):
    return r6(inv.diversity(A.trees(spark, d)).drop("species_shares"))


@query(T + "SELECT plot_id, floor(dbh_cm / 5)::BIGINT AS band, (floor(dbh_cm / 5) * 5)::BIGINT::VARCHAR || '-' || (floor(dbh_cm / 5) * 5 + 5)::BIGINT::VARCHAR AS label, count(*) AS stems FROM t WHERE dbh_cm > 0 GROUP BY 1, 2, 3")
def diameter_distribution(spark, d):
    return r6(inv.diameter_distribution(A.trees(spark, d)))


@query(T + f"SELECT plot_id, count(*) FILTER (dbh_cm > 0 AND height_m > 0) AS yield_basis_count, round(sum(0.5 * pi() * (dbh_cm / 200) ** 2 * height_m) FILTER (dbh_cm > 0 AND height_m > 0), 6) AS volume_m3, round(sum({BIOMASS}) FILTER (dbh_cm > 0 AND height_m > 0) / 1000, 6) AS biomass_t FROM t GROUP BY plot_id")
def stem_volume_biomass(spark, d):
    return r6(inv.yields(A.trees(spark, d)))


def _loo(value: str, keys: str, source: str) -> str:
    return f"""SELECT *, CASE WHEN n < 3 THEN 0 WHEN lo = hi AND {value} = lo THEN 0 WHEN lo = hi THEN NULL ELSE (({value} - m) * n / (n - 1)) / sqrt((ss - ({value} - m) ** 2 * n / (n - 1)) / (n - 2)) END AS z FROM (
    SELECT *, sum(({value} - m) ** 2) OVER (PARTITION BY {keys}) AS ss, least(min({value}) OVER a, min({value}) OVER b) AS lo, greatest(max({value}) OVER a, max({value}) OVER b) AS hi FROM (
        SELECT *, count(*) OVER (PARTITION BY {keys}) AS n, avg({value}) OVER (PARTITION BY {keys}) AS m FROM ({source}))
    WINDOW a AS (PARTITION BY {keys} ORDER BY tree_id, {value}, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY {keys} ORDER BY tree_id, {value}, x, y ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


DBH_Z = _loo("dbh_cm", "plot_id", "SELECT * FROM t WHERE dbh_cm > 0")
RESIDUALS = _loo("residual", "plot_id", "SELECT *, height_m - (1.3 + (dbh_cm / (1.45 + 0.178 * dbh_cm)) ** 2) AS residual FROM t WHERE dbh_cm > 0 AND height_m > 0")


@query(T + f"SELECT tree_id, plot_id, dbh_cm, round(z, 6) AS z FROM ({DBH_Z})")
def dbh_scores(spark, d):
    return r6(rules.dbh_scores(A.trees(spark, d)).select("tree_id", "plot_id", "dbh_cm", F.when(F.abs("z") != float("inf"), F.col("z")).alias("z")))


@query(T + f"SELECT tree_id, plot_id, round(residual, 6) AS residual, round(z, 6) AS z FROM ({RESIDUALS})")
def height_residual_default_curve(spark, d):
    return r6(rules.height_residuals(A.trees(spark, d)).select("tree_id", "plot_id", "residual", F.when(F.abs("z") != float("inf"), F.col("z")).alias("z")))


CURVE_SQL = {
    "curtis": ("1.3 + 30 * (dbh_cm / (1 + dbh_cm)) ** 3", "CASE WHEN q > 0 AND q < 1 THEN q / (1 - q) END", "((h - 1.3) / 30) ** (1 / 3.0)"),
    "naslund": ("1.3 + (dbh_cm / (1.45 + 0.178 * dbh_cm)) ** 2", "CASE WHEN 1 - 0.178 * q > 0 THEN 1.45 * q / (1 - 0.178 * q) END", "sqrt(h - 1.3)"),
    "power": ("2 * dbh_cm ** 0.6", "q", "(h / 2) ** (1 / 0.6)"),
    "chapman": ("1.3 + 30 * (1 - exp(-0.04 * dbh_cm)) ** 1", "CASE WHEN q < 1 THEN -ln(1 - q) / 0.04 END", "(h - 1.3) / 30"),
}


def _curve(name: str):
    at, invert, q = CURVE_SQL[name]
    least = "h > 0" if name == "power" else "h > 1.3"

    @query(T + f"SELECT tree_id, dbh_cm, round({at}, 6) AS height FROM t0 WHERE dbh_cm > 0", f"curve_{name}")
    def value(spark, d):
        return r6(inv.measured(A.trees(spark, d)).select("tree_id", "dbh_cm", curves.height(name, F.col("dbh_cm"), curves.START[name]).alias("height")))

    @query(C + f"SELECT row, col, round(CASE WHEN d BETWEEN 0.1 AND 51200 THEN d END, 6) AS dbh_cm FROM (SELECT row, col, {invert} AS d FROM (SELECT row, col, CASE WHEN {least} THEN {q} END AS q FROM (SELECT row, col, CASE WHEN {least.replace('h', 'v')} THEN v END AS h FROM v)))", f"curve_invert_{name}")
    def inverse(spark, d):
        return raster.valid(A.cells(spark, d)).select("row", "col", F.round(curves.diameter(name, F.col("v"), curves.START[name]), 6).alias("dbh_cm"))


for _name in CURVE_SQL:
    _curve(_name)


# Inspection
F_SQL = {
    "stocking": f"SELECT plot_id, CASE WHEN stems_per_ha < 200 THEN 'SV001' ELSE 'SV002' END AS code, CASE WHEN stems_per_ha < 200 THEN 2 ELSE 1 END AS severity, 'stand' AS subject, stems_per_ha AS value, CASE WHEN stems_per_ha < 200 THEN 200.0 ELSE 1400.0 END AS threshold FROM ({METRICS}) WHERE stems_per_ha < 200 OR stems_per_ha > 1400",
    "density_index": f"SELECT plot_id, CASE WHEN sdi < 150 THEN 'SV003' ELSE 'SV004' END, CASE WHEN sdi < 150 THEN 1 ELSE 2 END, 'stand', sdi, CASE WHEN sdi < 150 THEN 150.0 ELSE 900.0 END FROM ({METRICS}) WHERE sdi < 150 OR sdi > 900",
    "structural_diversity": f"SELECT plot_id, 'SV020', 1, 'stand', gini, 0.15 FROM ({GINI}) WHERE gini < 0.15",
    "species_diversity": f"SELECT plot_id, 'SV021', 1, 'stand', shannon, 0.35 FROM ({METRICS}) WHERE shannon < 0.35 UNION ALL SELECT plot_id, 'SV022', 1, 'species:' || species, share, 0.9 FROM ({SHARES}) WHERE share > 0.9",
    "height_anomalies": f"SELECT plot_id, 'SV030', CASE WHEN abs(z) >= 3.5 THEN 2 ELSE 1 END, 'tree:' || tree_id, abs(z), 2.5 FROM ({RESIDUALS}) WHERE abs(z) > 2.5",
    "dbh_outliers": f"SELECT plot_id, 'SV031', 1, 'tree:' || tree_id, abs(z), 3.0 FROM ({DBH_Z}) WHERE n >= 5 AND abs(z) > 3.0",
    "missing_measurements": "SELECT plot_id, 'SV040', 1, 'tree:' || tree_id, NULL, NULL FROM t WHERE dbh_cm IS NULL OR height_m IS NULL",
    "duplicate_ids": "SELECT plot_id, 'SV041', 3, 'tree:' || tree_id, count(*), 1.0 FROM t0 GROUP BY plot_id, tree_id HAVING count(*) > 1",
    "implausible_dimensions": "SELECT plot_id, 'SV042', 3, 'tree:' || tree_id, NULL, NULL FROM t0 WHERE dbh_cm <= 0 OR height_m <= 0 OR dbh_cm > 250 OR height_m > 120",
    "coordinates_in_extent": "SELECT plot_id, 'SV043', 2, 'tree:' || tree_id, NULL, NULL FROM t0 WHERE NOT (x BETWEEN 0 AND (SELECT max(user_id) + 1 FROM events) AND y BETWEEN 0 AND (SELECT max(day(ts)) FROM events))",
}
_ROW = "SELECT plot_id, code::VARCHAR AS code, severity::BIGINT AS severity, subject::VARCHAR AS subject, round(value::DOUBLE, 6) AS value, threshold::DOUBLE AS threshold FROM ({}) AS f(plot_id, code, severity, subject, value, threshold)"


#: Limits that fire on the adapter's stands, where the default ones stay silent.
TIGHT = Profile(min_gini=0.5, min_shannon=1.0985, max_species_share=0.34, dbh_outlier_z=1.65, max_plausible_dbh_cm=48.0, max_plausible_height_m=33.0)
_TIGHT_SQL = {"structural_diversity": (("0.15", "0.5"),), "species_diversity": (("0.35", "1.0985"), ("0.9", "0.34")), "dbh_outliers": (("3.0", "1.65"),), "implausible_dimensions": (("> 250", "> 48"), ("> 120", "> 33"))}


def _context(spark, d, profile: Profile | None = None) -> rules.Context:
    extent = A.rasters(spark, d).select(F.col("xll").alias("xmin"), F.col("yll").alias("ymin"), (F.col("xll") + F.col("ncols") * F.col("cellsize")).alias("xmax"), (F.col("yll") + F.col("nrows") * F.col("cellsize")).alias("ymax"))
    curve = A.plots(spark, d).select("plot_id", F.lit("").alias("species"), *fitting.default_model(F.lit("")))  # given, so that SQL can say the same
    return rules.Context(A.trees(spark, d), A.plots(spark, d), extent, profile or Profile(), models=curve)


def _rule(name: str):
    sql = F_SQL[name]
    for old, new in _TIGHT_SQL.get(name, ()):
        sql = sql.replace(old, new)

    @query(T + _ROW.format(sql), f"rule_{name}")
    def one(spark, d):
        return r6(rules.inspect(_context(spark, d, TIGHT if name in _TIGHT_SQL else None), [getattr(rules, name)]).drop("title"))


for _name in F_SQL:
    _rule(_name)
_ALL = " UNION ALL ".join(f"SELECT * FROM ({s}) AS f(plot_id, code, severity, subject, value, threshold)" for s in F_SQL.values())


@query(T + _ROW.format(_ALL))
def findings_all(spark, d):
    return r6(rules.inspect(_context(spark, d)).drop("title"))


@query(T + f"SELECT plot_id, severity::BIGINT AS severity, count(*) AS findings FROM ({_ROW.format(_ALL)}) GROUP BY 1, 2")
def findings_summary(spark, d):
    return r6(rules.summary(rules.inspect(_context(spark, d))))


@query(T + f"SELECT plot_id, max(severity)::BIGINT AS severity FROM ({_ROW.format(_ALL)}) GROUP BY 1")
def findings_worst(spark, d):
    return r6(rules.worst(rules.inspect(_context(spark, d))))


@query(T + f"SELECT plot_id, code, subject FROM ({_ROW.format(_ALL)}) WHERE severity >= 2")
def findings_at_or_above(spark, d):
    return rules.at_or_above(rules.inspect(_context(spark, d)), "warning").select("plot_id", "code", "subject")


@query()
def fit_naslund(spark, d):
    return fitting.model_rows(fitting.fit_by_species(A.trees(spark, d), "naslund"))


@query()
def fit_power(spark, d):
    return fitting.model_rows(fitting.fit_by_species(A.trees(spark, d), "power"))


@query()
def rule_height_anomalies_fitted(spark, d):
    return r6(rules.inspect(rules.Context(A.trees(spark, d), A.plots(spark, d)), [rules.height_anomalies]).drop("title"))


@query(T + """, o AS (SELECT DISTINCT l_suppkey AS plot_id, l_orderkey FROM lineitem), given AS (SELECT plot_id, l_orderkey::VARCHAR AS tree_id FROM o WHERE l_orderkey % 3 <> 0),
    blank AS (SELECT plot_id, l_orderkey, row_number() OVER (PARTITION BY plot_id ORDER BY l_orderkey) AS k FROM o WHERE l_orderkey % 3 = 0),
    free AS (SELECT plot_id, i, row_number() OVER (PARTITION BY plot_id ORDER BY i) AS k FROM (SELECT plot_id, unnest(range(1, count(*) + 1)) AS i FROM o GROUP BY plot_id) n WHERE NOT EXISTS (SELECT 1 FROM given WHERE given.plot_id = n.plot_id AND given.tree_id = n.i::VARCHAR))
SELECT plot_id, l_orderkey, l_orderkey::VARCHAR AS tree_id FROM o WHERE l_orderkey % 3 <> 0 UNION ALL SELECT plot_id, l_orderkey, i::VARCHAR FROM blank JOIN free USING (plot_id, k)""")
def id_generation(spark, d):
    """Ids of every third order are blanked and filled again with the least numbers that no stem of the plot has."""
    t = A._table(spark, d, "lineitem").select(F.col("l_suppkey").alias("plot_id"), "l_orderkey").distinct()
    t = t.withColumn("tree_id", F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.col("l_orderkey").cast("string")))
    return inv.generated_ids(t, "l_orderkey")


# Rasters
@query(C + "SELECT row::BIGINT AS row, col::BIGINT AS col, round(v, 6) AS v FROM c")
def grid_scan(spark, d):
    return r6(A.cells(spark, d).select("row", "col", "v"))


@query(C + "SELECT row::BIGINT AS row, col::BIGINT AS col, round(v, 6) AS v FROM v")
def valid_cells(spark, d):
    return r6(raster.valid(A.cells(spark, d)).select("row", "col", "v"))


@query(C + "SELECT row::BIGINT AS row, col::BIGINT AS col, round(least(greatest(v, 5.0), 20.0), 6) AS v FROM v UNION ALL SELECT row, col, NULL FROM c WHERE v IS NULL")
def clamp(spark, d):
    return r6(raster.clamped(A.cells(spark, d), 5.0, 20.0).select("row", "col", "v"))


@query(C + "SELECT row::BIGINT AS row, col::BIGINT AS col, round(coalesce(v, -1.0), 6) AS v FROM c")
def fill_nodata(spark, d):
    return r6(raster.filled(A.cells(spark, d), -1.0).select("row", "col", "v"))


@query(C + "SELECT row::BIGINT AS row, col::BIGINT AS col, round(sqrt(v), 6) AS v FROM c")
def map_values(spark, d):
    return r6(raster.mapped(A.cells(spark, d), F.sqrt).select("row", "col", "v"))


@query(C + "SELECT row::BIGINT AS row, col::BIGINT AS col, col + 0.5 AS x, nrows - row - 0.5 AS y FROM c, dim".replace("col + 0.5 AS x", "(col + 0.5)::DOUBLE AS x").replace("nrows - row - 0.5 AS y", "(nrows - row - 0.5)::DOUBLE AS y"))
def cell_center(spark, d):
    return r6(raster.centres(A.cells(spark, d), A.rasters(spark, d)).select("row", "col", "x", "y"))


@query(C + f", t0 AS ({A.TREES_SQL}) SELECT tree_id, CASE WHEN ok THEN CASE WHEN y = 0 THEN nrows - 1 ELSE nrows - 1 - least(floor(y), nrows - 1) END END::BIGINT AS row, CASE WHEN ok THEN least(floor(x), ncols - 1) END::BIGINT AS col FROM (SELECT *, x BETWEEN 0 AND ncols AND y BETWEEN 0 AND nrows AS ok FROM t0, dim)")
def point_to_cell(spark, d):
    t = A.trees(spark, d).select(F.lit("events").alias("raster_id"), "tree_id", "x", "y")
    return r6(raster.located(t, A.rasters(spark, d)).select("tree_id", "row", "col"))


@query(C + f", t0 AS ({A.TREES_SQL}) SELECT tree_id FROM (SELECT tree_id, (nrows - 1 - least(floor(y), nrows - 1))::BIGINT AS r, least(floor(x), ncols - 1)::BIGINT AS k FROM t0, dim WHERE x BETWEEN 0 AND ncols AND y BETWEEN 0 AND nrows) p JOIN v ON v.row = r AND v.col = k")
def observed_stems(spark, d):
    t = raster.located(A.trees(spark, d).select(F.lit("events").alias("raster_id"), "tree_id", "x", "y"), A.rasters(spark, d))
    return t.join(raster.valid(A.cells(spark, d)), list(raster.KEY), "left_semi").select("tree_id")


_DSM = "SELECT row, col, v + row * 0.1 AS s, row * 0.1 + col % 7 AS g FROM c"


@query(C + f"SELECT row::BIGINT AS row, col::BIGINT AS col, round(s + g, 6) AS v FROM ({_DSM})")
def grid_combine(spark, d):
    c = A.cells(spark, d)
    return r6(raster.combined(raster_dsm(c), raster_dtm(c), lambda a, b: a + b).select("row", "col", "v"))


@query(C + f"SELECT row::BIGINT AS row, col::BIGINT AS col, round(CASE WHEN s IS NOT NULL THEN greatest(s - g, 0) END, 6) AS v FROM ({_DSM})")
def canopy_height(spark, d):
    c = A.cells(spark, d)
    return r6(raster.canopy_height(raster_dsm(c), raster_dtm(c)).select("row", "col", "v"))


def raster_dsm(c: DataFrame) -> DataFrame:
    return c.withColumn("v", F.col("v") + F.col("row") * 0.1)


def raster_dtm(c: DataFrame) -> DataFrame:
    return c.withColumn("v", F.col("row") * 0.1 + F.col("col") % 7)


def _near(name: str, connectivity: int):
    cond = "abs(a.row - b.row) + abs(a.col - b.col) = 1" if connectivity == 4 else "greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1"

    @query(C + f"SELECT a.row::BIGINT AS row, a.col::BIGINT AS col, count(b.row) AS neighbours FROM v a LEFT JOIN v b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND {cond} GROUP BY 1, 2", name)
    def one(spark, d):
        return r6(raster.neighbours(A.cells(spark, d), connectivity).drop("raster_id"))


_near("neighbours4", 4)
_near("neighbours8", 8)


def _focal(name: str, how: str, f, radius: int):
    @query(C + f"SELECT a.row::BIGINT AS row, a.col::BIGINT AS col, round({how}(b.v), 6) AS v FROM v a JOIN v b ON b.row BETWEEN a.row - {radius} AND a.row + {radius} AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= {radius * radius} GROUP BY 1, 2", name)
    def one(spark, d):
        return r6(f(A.cells(spark, d), radius).drop("raster_id"))


_focal("focal_mean", "avg", raster.smooth_mean, 1)
_focal("focal_median", "median", raster.smooth_median, 2)
_focal("focal_max", "max", raster.focal_max, 2)


@query(C + "SELECT count(v) AS count, count(*) - count(v) AS nodata_count, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stdev FROM c")
def grid_stats(spark, d):
    return r6(raster.stats(A.cells(spark, d)).drop("raster_id"))


@query(C + "SELECT bin::BIGINT AS bin, (bin * 4.0)::DOUBLE AS lower, count(v) AS n FROM (SELECT unnest(range(0, 10)) AS bin) LEFT JOIN (SELECT least(9, floor(v / 4)) AS k, v FROM v WHERE v BETWEEN 0 AND 40) ON k = bin GROUP BY 1, 2")
def histogram(spark, d):
    return r6(raster.histogram(A.cells(spark, d), 10, 0.0, 40.0).drop("raster_id"))


@query(C + "SELECT round(avg((v >= 2)::INT), 6) AS cover, round(avg((v < 2)::INT), 6) AS gap_fraction, round(stddev_samp(v) FILTER (v >= 2), 6) AS rugosity FROM v")
def canopy_summary(spark, d):
    return r6(raster.canopy(A.cells(spark, d)).drop("raster_id"))


@query(C + "SELECT s.stratum, round(count(v) / (SELECT count(*) FROM v), 6) AS share FROM (VALUES (0, 'ground'), (1, 'regeneration'), (2, 'understorey'), (3, 'midstorey'), (4, 'canopy'), (5, 'emergent')) AS s(k, stratum) LEFT JOIN (SELECT v, CASE WHEN v < 0.5 THEN 0 WHEN v < 2 THEN 1 WHEN v < 5 THEN 2 WHEN v < 15 THEN 3 WHEN v < 25 THEN 4 ELSE 5 END AS k FROM v) USING (k) GROUP BY 1")
def strata(spark, d):
    return r6(raster.strata(A.cells(spark, d)).drop("raster_id"))


@query(C + "SELECT (row // 5)::BIGINT AS row, (col // 5)::BIGINT AS col, round(max(v), 6) AS v FROM c GROUP BY 1, 2")
def block_max_downsample(spark, d):
    return r6(raster.block_max(A.cells(spark, d), 5).drop("raster_id"))


@query(C + "SELECT row::BIGINT AS row, string_agg(CASE WHEN v IS NULL THEN '?' ELSE substr(' .:-=+*#%@&', least(10, floor((v - lo) / (hi - lo) * 11))::INT + 1, 1) END, '' ORDER BY col) AS line FROM c, (SELECT min(v) AS lo, max(v) AS hi FROM v) GROUP BY 1")
def ascii_rows(spark, d):
    return r6(raster.ascii_rows(A.cells(spark, d)).drop("raster_id"))


@query(C + ", b AS (SELECT row, col, v IS NULL OR v >= 8 AS blocked FROM c) SELECT a.row::BIGINT AS row, a.col::BIGINT AS col, round(CASE WHEN a.blocked THEN 0 ELSE least(a.row + 0.5, nrows - a.row - 0.5, a.col + 0.5, ncols - a.col - 0.5, min(CASE WHEN b.blocked THEN sqrt(greatest(abs(a.row - b.row) - 0.5, 0) ** 2 + greatest(abs(a.col - b.col) - 0.5, 0) ** 2) END)) END, 6) AS distance FROM b a, b, dim GROUP BY a.row, a.col, a.blocked, nrows, ncols")
def distance_to_canopy(spark, d):
    return r6(raster.distance_field(A.cells(spark, d), A.rasters(spark, d), 8.0).drop("raster_id"))


_OPEN = ", o AS (SELECT row, col, v FROM v WHERE v < 3)"


@query(C + _OPEN + "SELECT row::BIGINT AS row, col::BIGINT AS col FROM (SELECT row + i AS row, col + j AS col, count(*) AS n, count(*) FILTER (i = j) AS same FROM o, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS s(i, j) GROUP BY 1, 2) WHERE n = 3 OR n = 2 AND same IN (0, 2)")
def reflex_corners(spark, d):
    return r6(raster.reflex_corners(A.cells(spark, d), A.rasters(spark, d), 3.0).drop("raster_id"))


@query(C + _OPEN + """, e AS (SELECT side, CASE WHEN dr <> 0 THEN o.row ELSE o.col END AS line, CASE WHEN dr <> 0 THEN o.col ELSE o.row END AS pos FROM o CROSS JOIN (VALUES ('north', -1, 0), ('south', 1, 0), ('west', 0, -1), ('east', 0, 1)) AS s(side, dr, dc) WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.row = o.row + dr AND p.col = o.col + dc))
SELECT side, line::BIGINT AS line, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last FROM (SELECT *, pos - row_number() OVER (PARTITION BY side, line ORDER BY pos) AS g FROM e) GROUP BY side, line, g""")
def boundary_walls(spark, d):
    return r6(raster.wall_runs(A.cells(spark, d), 3.0).drop("raster_id"))


def _reach(connectivity: int) -> str:
    cond = "abs(a.row - b.row) + abs(a.col - b.col) <= 1" if connectivity == 4 else "abs(a.col - b.col) <= 1"
    # A component's least cell has no smaller neighbour, so spreading from such cells alone is enough.
    return f""", n AS (SELECT a.row AS r0, a.col AS c0, b.row, b.col FROM o a JOIN o b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND {cond}),
reach(r0, c0, k) AS (SELECT row, col, row * ncols + col FROM o, dim WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.r0 = o.row AND n.c0 = o.col AND n.row * ncols + n.col < o.row * ncols + o.col) UNION SELECT n.row, n.col, reach.k FROM reach JOIN n ON n.r0 = reach.r0 AND n.c0 = reach.c0),
lab AS (SELECT r0 AS row, c0 AS col, min(k)::BIGINT AS label FROM reach GROUP BY 1, 2)"""


def _labels(name: str, connectivity: int):
    @query(C + _OPEN + _reach(connectivity) + " SELECT row::BIGINT AS row, col::BIGINT AS col, label FROM lab", name)
    def one(spark, d):
        c = A.cells(spark, d)
        return r6(raster.labelled(c.filter("v < 3"), A.rasters(spark, d), connectivity).drop("raster_id"))


_labels("components4", 4)
_labels("components8", 8)


@query(C + _OPEN + _reach(8) + """ SELECT row_number() OVER (ORDER BY area DESC, label) AS gap_id, cells, area, centroid_x, centroid_y, mean_height, max_height, touches_edge FROM (
    SELECT label, count(*) AS cells, count(*)::DOUBLE AS area, round(avg(col + 0.5), 6) AS centroid_x, round(avg(nrows - row - 0.5), 6) AS centroid_y, round(avg(v), 6) AS mean_height, round(max(v), 6) AS max_height, bool_or(row = 0 OR col = 0 OR row = nrows - 1 OR col = ncols - 1) AS touches_edge FROM lab JOIN o USING (row, col), dim GROUP BY label) WHERE area >= 5""")
def gaps_raw(spark, d):
    return r6(raster.gaps(A.cells(spark, d), A.rasters(spark, d), 3.0, 5.0).drop("raster_id"))


@query(C + _OPEN + _reach(8) + " SELECT row::BIGINT AS row, col::BIGINT AS col FROM lab JOIN (SELECT label, bool_or(row = 0 OR col = 0 OR row = nrows - 1 OR col = ncols - 1) AS edge FROM lab, dim GROUP BY label) USING (label) WHERE edge")
def border_components(spark, d):
    return r6(raster.border_reaching(A.cells(spark, d), A.rasters(spark, d), 3.0).drop("raster_id"))


# A circle of radius 0.5 fits in every open cell, so opening by a width of 1 changes nothing.
@query(C + "SELECT row::BIGINT AS row, col::BIGINT AS col FROM v WHERE v < 8")
def opening_by_one_cell(spark, d):
    return r6(openings.opened_cells(A.cells(spark, d), A.rasters(spark, d), 8.0, 0.5).select("row", "col"))


@query()
def opening_mask(spark, d):
    return r6(openings.opened_cells(A.cells(spark, d), A.rasters(spark, d), 8.0, 1.5).select("row", "col"))


@query()
def gaps_opened(spark, d):
    return r6(raster.gaps(A.cells(spark, d), A.rasters(spark, d), 8.0, 5.0, min_width=2.0, with_width=True).drop("raster_id"))


@query()
def inscribed_circle(spark, d):
    lab = raster.labelled(A.cells(spark, d).filter("v < 3"), A.rasters(spark, d))
    return r6(openings.widths(lab).drop("raster_id"))


@query(C + "SELECT a.row::BIGINT AS row, a.col::BIGINT AS col, round(a.v, 6) AS v FROM v a WHERE a.v >= 2 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.v > a.v AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= (0.8 + 0.055 * a.v) ** 2)")
def treetop_candidates(spark, d):
    return r6(raster.treetop_candidates(A.cells(spark, d), A.rasters(spark, d)).drop("raster_id"))


@query()
def treetops(spark, d):
    return r6(crowns.treetops(raster.treetop_candidates(A.cells(spark, d), A.rasters(spark, d))).drop("raster_id"))


@query()
def detected_crowns(spark, d):
    return r6(crowns.detect_trees(A.cells(spark, d), A.rasters(spark, d)).drop("raster_id"))


# Matching
_PTS = f", a AS (SELECT plot_id, tree_id AS a_id, x AS ax, y AS ay FROM t0 WHERE status = 'dead' AND species = 'A'), b AS (SELECT plot_id, tree_id AS b_id, x AS bx, y AS b_y FROM t0 WHERE status = 'live' AND species = 'N')"


def _points(spark, d):
    t = A.trees(spark, d)
    crowns = t.filter("status = 'dead' AND species = 'A'").select("plot_id", F.col("tree_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("height_m").alias("a_height"))
    return crowns, t.filter("status = 'live' AND species = 'N'").select("plot_id", F.col("tree_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("height_m").alias("b_height"))


@query(T + _PTS + "SELECT plot_id, a_id, b_id, round(sqrt((ax - bx) ** 2 + (ay - b_y) ** 2), 6) AS distance FROM a JOIN b USING (plot_id) WHERE sqrt((ax - bx) ** 2 + (ay - b_y) ** 2) <= 2.5")
def match_candidates(spark, d):
    return r6(matching.range_join(*_points(spark, d), 2.5).select("plot_id", "a_id", "b_id", "distance"))


@query(T.replace("WITH t0", "WITH RECURSIVE t0", 1) + _PTS + """, e AS (SELECT plot_id, a_id, b_id FROM a JOIN b USING (plot_id) WHERE sqrt((ax - bx) ** 2 + (ay - b_y) ** 2) <= 2.5),
    n AS (SELECT DISTINCT x.plot_id, x.a_id AS i, y.a_id AS j FROM e x JOIN e y USING (plot_id, b_id)),
    reach(plot_id, i, j) AS (SELECT plot_id, i, j FROM n UNION SELECT reach.plot_id, reach.i, n.j FROM reach JOIN n ON n.plot_id = reach.plot_id AND n.i = reach.j)
    SELECT plot_id, i AS a_id, min(j) AS component FROM reach GROUP BY 1, 2""")
def match_components(spark, d):
    found = matching.match_components(matching.range_join(*_points(spark, d), 2.5))
    field = lambda c, k: F.get_json_object(c, f"$.{k}")
    crowns = found.filter(field("id", "kind") == "c")
    return crowns.select(field("id", "plot_id").cast("long").alias("plot_id"), field("id", "id").alias("a_id"), field("component", "id").alias("component"))


@query()
def match_pairs(spark, d):
    return r6(matching.match_pairs(matching.range_join(*_points(spark, d), 2.5)).select("plot_id", "a_id", "b_id", "distance"))


@query()
def match_summary(spark, d):
    a, b = _points(spark, d)
    return r6(matching.match_summary(matching.match_pairs(matching.range_join(a, b, 2.5)), a, b))
