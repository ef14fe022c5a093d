"""Command line: python -m groveline.cli COMMAND ... Exit code 0 is well, 1 findings, 2 bad input."""

from __future__ import annotations

import argparse
import json
import math
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline import session
from groveline.functions import fitting
from groveline.operators import crowns as cr
from groveline.operators import inventory as inv
from groveline.operators import matching, raster
from groveline.plans import report, rules
from groveline.plans.profile import Profile
from groveline.sources import geotiff, grids, inventories, rasters, stands


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise argparse.ArgumentTypeError(f"{text} is not finite")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="groveline")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(n)
        for k, v in options.items():
            p.add_argument("--" + k.replace("_", "-"), **v)
        return p

    flag, real = {"action": "store_true"}, lambda d=None: {"type": _finite, "default": d}
    command("chm", dsm={"required": True}, dtm={"required": True}, output={})
    command("detect", "chm", min_height=real(2.0), smooth_radius={"type": int, "default": 1}, output={}, json=flag)
    command("metrics", "inventory", area_ha={"type": _finite, "required": True}, include_dead=flag, json=flag)
    command("gaps", "chm", threshold=real(2.0), min_area=real(25.0), min_width=real(5.0), json=flag)
    command("render", "chm", width={"type": int, "default": 72}, tops=flag)
    command("match", "inventory", chm={"required": True}, tolerance=real(2.5), json=flag)
    command("allometry", "inventory", model={"default": fitting.FAMILY}, json=flag)
    command("inspect", chm={}, inventory={}, area_ha=real(), config={}, format={"choices": ("text", "markdown", "json"), "default": "text"}, output={}, no_detection=flag, with_map=flag, fail_on={})
    command("synth", out={"default": "stand"}, seed={"type": int, "default": 1}, width=real(100.0), height=real(100.0), cellsize=real(0.5), stems_per_ha=real(320.0), gaps={"type": int, "default": 2})
    command("demo", seed={"type": int, "default": 1}, format={"choices": ("text", "markdown", "json"), "default": "text"})
    return top


def _raster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    heads, cells = rasters.read_raster(spark, path)
    name = F.lit("plot").alias("raster_id")
    return heads.select(name, *(c for c in heads.columns if c != "raster_id")), session.cut(cells.select(name, "row", "col", "v"))


def _stems(spark: SparkSession, path: str) -> DataFrame:
    return session.cut(inventories.read_inventories(spark, path).withColumn("plot_id", F.lit("plot")))


def _say(rows: list[dict], as_json: bool) -> None:
    if as_json:
        print(json.dumps([{k: report.rounded(v, 6) for k, v in r.items()} for r in rows], indent=2, allow_nan=False, default=str))
    else:
        for r in rows:
            print(", ".join(f"{k} {report.number(v, 3)}" for k, v in r.items()))


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _write_raster(heads: DataFrame, cells: DataFrame, path: str) -> None:
    if path.lower().endswith(".asc"):
        Path(path).write_text(grids.grid_texts(heads, cells, None).first()["value"] + "\n")
    elif path.lower().endswith((".tif", ".tiff")):
        Path(path).write_bytes(bytes(geotiff.tiff_files(heads, cells).first()["content"]))
    else:
        raise ValueError(f"{path}: unknown raster suffix")


def _matched(cells: DataFrame, heads: DataFrame, trees: DataFrame, tolerance: float) -> DataFrame:
    """Summary of detections against the live stems that stand on observed cells."""
    found = cr.inventory_of(cr.detect_trees(cells, heads), heads)
    a = found.select("plot_id", F.col("tree_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("height_m").alias("a_height"))
    placed = raster.located(inv.live(trees).withColumn("raster_id", F.col("plot_id")), heads).join(raster.valid(cells).select(*raster.KEY), list(raster.KEY), "left_semi")
    b = placed.select("plot_id", F.col("tree_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("height_m").alias("b_height"))
    a, b = session.cut(a), session.cut(b)
    return matching.match_summary(matching.match_pairs(matching.range_join(a, b, tolerance)), a, b)


def _inspect(spark: SparkSession, args, heads, cells, trees) -> int:
    if heads is None and trees is None:
        raise ValueError("inspect needs a raster or an inventory")
    area = args.area_ha
    if area is None and heads is not None:
        h = heads.first()
        area = h.nrows * h.ncols * h.cellsize**2 / 10_000
    if area is None or area <= 0:
        raise ValueError("the area must be given, and positive")
    profile = Profile.load(args.config) if getattr(args, "config", None) else Profile()
    plots = spark.createDataFrame([("plot", area)], "plot_id string, area_ha double")
    match, extent, source = None, None, "field"
    seen = cells is not None and not raster.valid(cells).isEmpty()
    if heads is not None:
        extent = heads.select(F.col("raster_id").alias("plot_id"), F.col("xll").alias("xmin"), F.col("yll").alias("ymin"), (F.col("xll") + F.col("ncols") * F.col("cellsize")).alias("xmax"), (F.col("yll") + F.col("nrows") * F.col("cellsize")).alias("ymax"))
    if seen and not getattr(args, "no_detection", False):
        if trees is None:
            trees, source = session.cut(cr.inventory_of(cr.detect_trees(cells, heads), heads)), "detected"
        else:
            match = session.cut(_matched(cells, heads, trees, profile.match_tolerance_m))
    ctx = rules.Context(trees, plots, extent if source == "field" else None, profile, cells=cells if seen else None, rasters=heads, match=match)
    found = report.collect(ctx, "plot", source)
    drawn = report.ascii_map(_rows(heads, cells)) if getattr(args, "with_map", False) and heads is not None else None
    text = report.to_json(found) + "\n" if args.format == "json" else report.to_markdown(found, drawn) if args.format == "markdown" else report.to_text(found, drawn)
    if getattr(args, "output", None):
        Path(args.output).write_text(text)
    else:
        print(text, end="")
    level = getattr(args, "fail_on", None)
    return int(bool(level) and bool(found.findings) and found.worst() >= rules.severity(level))


def _rows(heads: DataFrame, cells: DataFrame) -> list[list]:
    h = heads.first()
    out = [[None] * h.ncols for _ in range(h.nrows)]
    for r in cells.collect():  # one raster, to be drawn
        out[r.row][r.col] = r.v
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "chm":
        (ha, a), (hb, b) = _raster(spark, args.dsm), _raster(spark, args.dtm)
        out = raster.canopy_height(a, b, headers=(ha, hb))
        if args.output:
            _write_raster(ha, out, args.output)
        else:
            print(grids.grid_texts(ha, out, None).first()["value"])
    elif args.command == "detect":
        heads, cells = _raster(spark, args.chm)
        found = cr.inventory_of(cr.detect_trees(cells, heads, args.min_height, args.smooth_radius), heads)
        rows = _dicts(found.drop("plot_id").orderBy(F.length("tree_id"), "tree_id"))
        if args.output:
            import pandas as pd

            pd.DataFrame(rows, columns=inventories.COLUMNS).round(3).to_csv(args.output, index=False)
        _say(rows, args.json)
    elif args.command == "metrics":
        trees = _stems(spark, args.inventory)
        trees = trees.withColumn("status", F.lit("live")) if args.include_dead else trees
        if args.area_ha <= 0:
            raise ValueError("the area must be positive")
        _say(_dicts(inv.stand_metrics(trees, spark.createDataFrame([("plot", args.area_ha)], "plot_id string, area_ha double")).drop("plot_id")), args.json)
    elif args.command == "gaps":
        heads, cells = _raster(spark, args.chm)
        _say(_dicts(raster.gaps(cells, heads, args.threshold, args.min_area, min_width=args.min_width, with_width=True).drop("raster_id").orderBy("gap_id")), args.json)
    elif args.command == "render":
        heads, cells = _raster(spark, args.chm)
        marks = report.crown_markers(_dicts(cr.detect_trees(cells, heads))) if args.tops else None
        print(report.ascii_map(_rows(heads, cells), args.width, markers=marks))
    elif args.command == "match":
        heads, cells = _raster(spark, args.chm)
        _say(_dicts(_matched(cells, heads, _stems(spark, args.inventory), args.tolerance).drop("plot_id")), args.json)
    elif args.command == "allometry":
        pairs = inv.paired(_stems(spark, args.inventory)).select("dbh_cm", "height_m").toPandas()
        _say([fitting.fit_pairs(pairs["dbh_cm"].to_numpy(), pairs["height_m"].to_numpy(), args.model)], args.json)
    elif args.command == "inspect":
        heads, cells = _raster(spark, args.chm) if args.chm else (None, None)
        return _inspect(spark, args, heads, cells, _stems(spark, args.inventory) if args.inventory else None)
    elif args.command in ("synth", "demo"):
        stand = stands.Stand() if args.command == "demo" else stands.Stand(args.width, args.height, args.cellsize, args.stems_per_ha, gaps=args.gaps)
        trees, heads, cells = stands.synthesize(spark, [args.seed], stand)
        if args.command == "demo":
            name = F.lit("plot")
            args.area_ha = None
            return _inspect(spark, args, heads.withColumn("raster_id", name), session.cut(cells.select(name.alias("raster_id"), "row", "col", "v")), session.cut(trees.withColumn("plot_id", name)))
        folder = Path(args.out)
        folder.mkdir(parents=True, exist_ok=True)
        for part, column in (("chm", "v"), ("dtm", "ground"), ("dsm", "surface")):
            text = grids.grid_texts(heads, cells.select("raster_id", "row", "col", F.col(column).alias("v")), 2).first()["value"]
            (folder / f"{part}.asc").write_text(text + "\n")
        trees.drop("plot_id").toPandas()[list(inventories.COLUMNS)].round(3).to_csv(folder / "trees.csv", index=False)
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        return run(spark or session.build(), args)
    except (ValueError, OSError, PySparkException) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
