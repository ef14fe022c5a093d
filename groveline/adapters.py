"""Views that recast the driver's tables as inventories, plots and rasters; the SQL runs in Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AREA_HA = 0.25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TREES_SQL = """SELECT cast(l_orderkey AS varchar(40)) || '-' || cast(l_linenumber AS varchar(40)) AS tree_id, l_suppkey AS plot_id, l_returnflag AS species,
    CASE WHEN l_linestatus = 'O' THEN 'live' ELSE 'dead' END AS status, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS dbh_cm,
    CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / 3000 END AS height_m, (l_partkey % 100) * 1.0e0 + l_discount AS x, (l_orderkey % 100) * 1.0e0 + l_tax AS y FROM lineitem"""
CELLS_SQL = """SELECT g.r AS row, g.c AS col, v.v AS v FROM (SELECT r, c FROM (SELECT unnest(range(0, (SELECT max(day(ts)) FROM events))) AS r), (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) AS c)) g
    LEFT JOIN (SELECT day(ts) - 1 AS r, user_id AS c, max(value) / 15 AS v FROM events GROUP BY 1, 2) v ON g.r = v.r AND g.c = v.c"""


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tree_id"), F.col("l_suppkey").alias("plot_id"), F.col("l_returnflag").alias("species"),
        F.when(F.col("l_linestatus") == "O", "live").otherwise("dead").alias("status"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity")).alias("dbh_cm"), F.when(F.col("l_discount") != 0, F.col("l_extendedprice") / 3000).alias("height_m"),
        ((F.col("l_partkey") % 100).cast("double") + F.col("l_discount")).alias("x"), ((F.col("l_orderkey") % 100).cast("double") + F.col("l_tax")).alias("y"),
    )


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("plot_id"), F.lit(AREA_HA).alias("area_ha"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _table(spark, sf_dir, "events").agg(F.max(F.dayofmonth("ts")).alias("nrows"), (F.max("user_id") + 1).cast("int").alias("ncols"))
    return ev.select(F.lit("events").alias("raster_id"), "ncols", "nrows", F.lit(0.0).alias("xll"), F.lit(0.0).alias("yll"), F.lit(1.0).alias("cellsize"), F.lit(-9999.0).alias("nodata"), F.lit(None).cast("string").alias("crs"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cells (raster_id, row, col, v) of the events raster: largest value by day and user."""
    from groveline.operators.raster import scaffold

    values = _table(spark, sf_dir, "events").groupBy((F.dayofmonth("ts") - 1).alias("row"), F.col("user_id").cast("int").alias("col")).agg((F.max("value") / 15).alias("v"))
    return scaffold(rasters(spark, sf_dir)).join(values, ["row", "col"], "left").select("raster_id", "row", "col", "v")
