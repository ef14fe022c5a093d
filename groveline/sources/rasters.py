"""Rasters by the suffix of their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groveline.sources import geotiff, grids

#: Reader by suffix; add to it to read other formats.
READERS: dict[str, Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]] = {"asc": grids.read_grids, "tif": geotiff.read_tiffs, "tiff": geotiff.read_tiffs}


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rasters, cells) of the file or glob at ``path``; an unknown suffix is refused before anything is read."""
    suffix = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix not in READERS:
        raise ValueError(f"{path}: unknown raster suffix; there are {sorted(READERS)}")
    return READERS[suffix](spark, path)
