"""Inventory CSV: whole files to stems in file order, and back."""

from __future__ import annotations

import csv
import io
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: columns, the names accepted for each, and texts that stand for a missing value.
COLUMNS = ("tree_id", "x", "y", "species", "dbh_cm", "height_m", "crown_diameter_m", "status")
ALIASES = {
    "tree_id": ("id", "treeid", "tree", "stem_id"),
    "x": ("easting", "x_m"),
    "y": ("northing", "y_m"),
    "species": ("sp", "species_code"),
    "dbh_cm": ("dbh", "d", "diameter", "diameter_cm"),
    "height_m": ("height", "h", "ht"),
    "crown_diameter_m": ("crown_diameter", "cd", "crown_width_m"),
    "status": ("state",),
}
MISSING = ("", "NA", "NAN", "NULL", "-")
NUMBERS = ("x", "y", "dbh_cm", "height_m", "crown_diameter_m")

SCHEMA = "plot_id string, row_no long, tree_id string, x double, y double, species string, dbh_cm double, height_m double, crown_diameter_m double, status string"


def _header(names: list[str]) -> dict[int, str]:
    known = {a: c for c in COLUMNS for a in (c, *ALIASES[c])}
    fields: dict[int, str] = {}
    for i, name in enumerate(names):
        field = known.get(name.strip().lower().replace(" ", "_").replace("-", "_"))
        if field in fields.values():
            raise ValueError(f"two columns give {field}")
        if field:
            fields[i] = field
    if absent := {"x", "y"} - set(fields.values()):
        raise ValueError(f"no column {', '.join(sorted(absent))}")
    return fields


def _number(text: str, row: int, field: str) -> float | None:
    if text.upper() in MISSING:
        return None
    try:
        value = math.nan if "_" in text else float(text)
    except ValueError:
        value = math.nan
    if not math.isfinite(value):
        raise ValueError(f"row {row}: {field} value {text!r} is not a finite number")
    return value


def parse_inventory(text: str) -> list[dict]:
    """Stems of one file; those without an id get the least numbers that no stem has."""
    lines = [x for x in csv.reader(io.StringIO(text.removeprefix("﻿")))]
    if not lines:
        raise ValueError("no header")
    fields, out = _header(lines[0]), []
    for n, line in enumerate(lines[1:], 2):
        if not any(x.strip() for x in line):
            continue
        if any(x.strip() for x in line[len(lines[0]) :]):
            raise ValueError(f"row {n}: more cells than columns")
        given = {field: (line[i].strip() if i < len(line) else "") for i, field in fields.items()}
        stem: dict = {"row_no": n - 1} | {k: given.get(k, "") for k in COLUMNS if k not in NUMBERS} | {k: _number(given.get(k, ""), n, k) for k in NUMBERS}
        if stem["x"] is None or stem["y"] is None:
            raise ValueError(f"row {n}: no position")
        stem["status"] = stem["status"] or "live"
        out.append(stem)
    taken, number = {s["tree_id"] for s in out}, 0
    for stem in out:
        while not stem["tree_id"]:
            number += 1
            if (name := str(number)) not in taken:
                stem["tree_id"] = name
    return out


def read_inventories(spark: SparkSession, path: str) -> DataFrame:
    """Stems of the CSV files at ``path``; ``plot_id`` is the file's name without suffix, ``row_no`` the line's number."""
    files = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").text(path, wholetext=True)
    files = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("plot_id"), "value")
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for plot, text in zip(batch["plot_id"], batch["value"], strict=True):
                try:
                    yield pd.DataFrame([{"plot_id": plot} | s for s in parse_inventory(text)], columns=names)
                except ValueError as e:
                    raise ValueError(f"{plot}: {e}") from e

    return files.mapInPandas(parse, SCHEMA)


def write_inventories(trees: DataFrame, path: str, places: int = 3) -> None:
    """One folder ``plot_id=...`` of CSV for each plot, columns in the canonical order, missing values empty."""
    rounded = [F.round(c, places).alias(c) if c in NUMBERS else F.col(c) for c in COLUMNS]
    trees.repartition("plot_id").select("plot_id", *rounded).write.partitionBy("plot_id").option("header", True).option("emptyValue", "").csv(path)
