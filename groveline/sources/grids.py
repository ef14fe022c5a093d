"""ASCII grids: files in a folder to (rasters, cells), and back, one file a raster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
KEYS = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")
NODATA = -9999.0

_SCHEMA = "raster_id string, ncols int, nrows int, xll double, yll double, cellsize double, nodata double, crs string, v array<double>"


def _dimension(value: float, key: str) -> int:
    if value != int(value) or value <= 0:
        raise ValueError(f"{key} {value!r} is not a positive whole number")
    return int(value)


def parse_grid(text: str) -> dict:
    """Header and row-major values of one grid; cells equal to the nodata value are None."""
    lines, head = text.removeprefix("﻿").splitlines(), {}
    at = 0
    for at, line in enumerate([*lines, "end"]):  # noqa: B007
        tokens = line.split()
        if not tokens:
            continue
        key = tokens[0].lower()
        if key not in KEYS:
            break
        if key in head:
            raise ValueError(f"{key} is given twice")
        if len(tokens) != 2:
            raise ValueError(f"{key} needs one value")
        head[key] = float(tokens[1])
    if missing := [k for k in ("ncols", "nrows", "cellsize") if k not in head]:
        raise ValueError(f"no {', '.join(missing)} in the header")
    if not all(np.isfinite(list(head.values()))) or head["cellsize"] <= 0:
        raise ValueError("header values must be finite, and cellsize above 0")
    ncols, nrows, size = _dimension(head["ncols"], "ncols"), _dimension(head["nrows"], "nrows"), head["cellsize"]
    origin = []
    for axis in "xy":
        corner, centre = head.get(f"{axis}llcorner"), head.get(f"{axis}llcenter")
        if corner is not None and centre is not None:
            raise ValueError(f"both corner and centre of {axis} are given")
        origin.append(corner if corner is not None else centre - size / 2 if centre is not None else 0.0)
    body = np.array(" ".join(lines[at:]).split(), float)
    if len(body) != ncols * nrows:
        raise ValueError(f"{len(body)} values, but the header says {ncols * nrows}")
    if not np.isfinite(body).all():
        raise ValueError("values must be finite")
    nodata = head.get("nodata_value", NODATA)
    return {"ncols": ncols, "nrows": nrows, "xll": origin[0], "yll": origin[1], "cellsize": size, "nodata": nodata, "crs": None, "v": [None if x == nodata else x for x in body.tolist()]}


def read_grids(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rasters, cells) of the ``.asc`` files at ``path``; a raster's id is its file's name without suffix."""
    files = spark.read.option("pathGlobFilter", "*.[aA][sS][cC]").text(path, wholetext=True)
    files = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("raster_id"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["raster_id"], batch["value"], strict=True):
                try:
                    yield pd.DataFrame([{"raster_id": name} | parse_grid(text)])
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e

    grids = files.mapInPandas(parse, _SCHEMA)
    every = grids.select("raster_id", "ncols", F.posexplode("v").alias("at", "v"))
    cells = every.select("raster_id", F.expr("cast(at div ncols AS int)").alias("row"), (F.col("at") % F.col("ncols")).cast("int").alias("col"), "v")
    return grids.drop("v"), cells


def grid_texts(rasters: DataFrame, cells: DataFrame, places: int | None = 3) -> DataFrame:
    """(raster_id, value): each raster as grid text. A value that would read back as nodata is an error."""
    number = F.col("v") if places is None else F.round("v", places)
    written = cells.join(rasters.select("raster_id", "nodata"), "raster_id")
    clash = F.raise_error(F.concat(F.lit("a value reads back as nodata in "), "raster_id")).cast("string")
    token = F.when(F.col("v").isNull(), F.col("nodata").cast("string")).when(number == F.col("nodata"), clash).otherwise(number.cast("string"))
    rows = written.groupBy("raster_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", token.alias("t")))).alias("c"))
    lines = rows.select("raster_id", "row", F.array_join(F.col("c.t"), " ").alias("line"))
    body = lines.groupBy("raster_id").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l"))
    head = [F.concat(F.lit(f"{k} "), F.col(c).cast("string")) for k, c in (("ncols", "ncols"), ("nrows", "nrows"), ("xllcorner", "xll"), ("yllcorner", "yll"), ("cellsize", "cellsize"), ("NODATA_value", "nodata"))]
    return rasters.join(body, "raster_id").select("raster_id", F.concat_ws("\n", *head, F.array_join(F.col("l.line"), "\n")).alias("value"))


def write_grids(rasters: DataFrame, cells: DataFrame, path: str, places: int | None = 3) -> None:
    """One folder ``raster_id=...`` of text for each raster."""
    grid_texts(rasters, cells, places).write.partitionBy("raster_id").text(path)
