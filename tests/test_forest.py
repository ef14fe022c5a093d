import itertools
import json
import math
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from groveline import catalogue
from groveline.functions import curves, fitting
from groveline.operators import inventory as inv
from groveline.operators import matching, openings, raster
from groveline.plans import rules
from groveline.plans.profile import Profile

DATA = "/root/testdata/sf0.001"
SOME = ("border_components", "canopy_height", "findings_worst", "id_generation", "match_components", "opening_by_one_cell", "rule_dbh_outliers", "rule_implausible_dimensions", "rule_species_diversity", "rule_structural_diversity", "stand_metrics", "gini", "diameter_distribution", "dbh_scores", "findings_all", "focal_mean", "distance_to_canopy", "components8", "treetop_candidates", "match_candidates", "histogram", "strata", "curve_invert_curtis", "boundary_walls")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, duck, name, tmp_path):
    catalogue.QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    duck.execute(f"CREATE OR REPLACE TEMP TABLE o AS {catalogue.ORACLE_SQL[name]}")
    cols = ", ".join(sorted(r[0] for r in duck.execute("DESCRIBE o").fetchall()))
    for a, b in (("o", f"'{tmp_path}/out/*.parquet'"), (f"'{tmp_path}/out/*.parquet'", "o")):
        assert duck.execute(f"SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b})").fetchone()[0] == 0


def _trees(spark, rows):
    return spark.createDataFrame(rows, "tree_id string, plot_id long, species string, status string, dbh_cm double, height_m double, x double, y double")


def test_unknown_is_not_zero(spark):
    plots = spark.createDataFrame([(1, 0.25), (2, 0.25)], "plot_id long, area_ha double")
    trees = _trees(spark, [("a", 1, "PIAB", "live", None, None, 0.0, 0.0)])
    one, two = inv.stand_metrics(trees, plots).orderBy("plot_id").collect()
    assert (one.tree_count, one.measured_count, one.basal_area_per_ha, one.volume_per_ha_m3) == (1, 0, None, None)
    assert (two.tree_count, two.qmd_cm) == (0, None)


def test_class_of_a_diameter_on_a_decimal_boundary(spark):
    trees = _trees(spark, [("a", 1, "X", "live", 0.3, 1.0, 0.0, 0.0)])
    row = inv.diameter_distribution(trees, 0.1).collect()[0]
    assert (row.band, row.label) == (3, "0.3-0.4")


def test_a_value_on_the_limit_never_fires(spark):
    plots = spark.createDataFrame([(1, 1.0)], "plot_id long, area_ha double")
    trees = _trees(spark, [(str(i), 1, "X", "live", 30.0, 20.0, 0.0, 0.0) for i in range(5)])
    ctx = rules.Context(trees, plots, profile=Profile(min_stems_per_ha=5))
    assert rules.stocking(ctx)[0].count() == 0


def test_ids_are_generated_around_the_given_ones(spark):
    t = spark.createDataFrame([(1, "", 1), (1, "2", 2), (1, None, 3), (1, "01", 4)], "plot_id long, tree_id string, o int")
    assert sorted(r.tree_id for r in inv.generated_ids(t, "o").collect()) == ["01", "1", "2", "3"]


def test_profile(tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"min_gini": 0.25}))
    assert Profile.load(str(p)).min_gini == 0.25
    p.write_text(json.dumps({"other": 1}))
    with pytest.raises(ValueError):
        Profile.load(str(p))
    for bad in ({"min_gini": -1}, {"max_gap_fraction": 2}, {"match_tolerance_m": 0}, {"min_sdi": 1000}, {"min_gini": math.nan}):
        with pytest.raises(ValueError):
            Profile(**bad)


def test_pairing_is_the_best_of_all():
    rnd = random.Random(3)
    for _ in range(60):
        n, m = rnd.randint(1, 4), rnd.randint(1, 4)
        edges = [(f"a{i}", f"b{j}", float(rnd.randint(1, 3))) for i in range(n) for j in range(m) if rnd.random() < 0.7]
        if not edges:
            continue
        got = matching._pair(pd.DataFrame(edges, columns=["a_id", "b_id", "distance"]))
        best = None
        for k in range(len(edges), 0, -1):
            for pick in itertools.combinations(edges, k):
                if len({e[0] for e in pick}) == k == len({e[1] for e in pick}):
                    key = sorted(e[2] for e in pick)
                    best = key if best is None or key < best else best
            if best:
                break
        assert sorted(got.distance) == best


def test_canopy_and_detection_findings(spark):
    """A 4 x 4 raster with an inner gap of one cell and an edge gap of four; plot 2 has no observed cell and no stems."""
    plots = spark.createDataFrame([(1, 1.0), (2, 1.0)], "plot_id long, area_ha double")
    low = {(1, 1), (3, 0), (3, 1), (3, 2), (3, 3)}
    cells = spark.createDataFrame([(k, r, c, (1.0 if (r, c) in low else 9.0) if k == 1 else None) for k in (1, 2) for r in range(4) for c in range(4)], "raster_id long, row int, col int, v double")
    rasters = spark.createDataFrame([(k, 4, 4, 0.0, 0.0, 10.0) for k in (1, 2)], "raster_id long, ncols int, nrows int, xll double, yll double, cellsize double")
    crowns = spark.createDataFrame([(1, "c1", 0.0, 0.0, 20.0), (1, "c2", 50.0, 0.0, 10.0), (1, "c3", 90.0, 0.0, 10.0), (2, "c4", 0.0, 0.0, 9.0)], "plot_id long, a_id string, ax double, ay double, a_height double")
    stems = spark.createDataFrame([(1, "s1", 1.0, 0.0, 17.0), (1, "s2", 50.0, 1.0, 9.0), (1, "s3", 200.0, 0.0, None)], "plot_id long, b_id string, bx double, by double, b_height double")
    matched = matching.match_pairs(matching.range_join(crowns, stems, 2.5))
    assert [r.b_id for r in matching.omissions(matched, stems).collect()] == ["s3"]
    assert sorted(r.a_id for r in matching.commissions(matched, crowns).collect()) == ["c3", "c4"]
    match = matching.match_summary(matched, crowns, stems)
    one, two = match.orderBy("plot_id").collect()
    assert (one.matched, one.omissions, one.commissions, one.height_bias_m, one.height_rmse_m) == (2, 1, 1, 2.0, math.sqrt(5))
    assert (two.matched, two.commissions, two.recall, two.precision, two.height_bias_m) == (0, 1, None, 0.0, None)
    ctx = rules.Context(None, plots, cells=cells, rasters=rasters, match=match, profile=Profile(min_canopy_cover=0.7, max_gap_fraction=0.3, max_gap_area=90.0, min_gap_width=0.0))
    got = sorted((r.plot_id, r.code, r.severity, r.subject, round(r.value, 6)) for r in rules.inspect(ctx).collect())
    assert got == [(1, "SV010", 2, "stand", 0.6875), (1, "SV011", 2, "gap:1", 400.0), (1, "SV011", 3, "gap:2", 100.0), (1, "SV012", 1, "stand", 0.3125),
                   (1, "SV050", 2, "detection", 0.666667), (1, "SV051", 2, "detection", 0.666667), (1, "SV052", 2, "detection", 2.0), (2, "SV051", 2, "detection", 0.0)]


def test_match_summary_query(spark):
    rows = catalogue.QUERIES["match_summary"](spark, DATA).collect()
    assert rows and all(r.matched + r.omissions == r.reference and r.matched + r.commissions == r.detected for r in rows)


def _grid(spark, rows, cellsize=1.0, name="g"):
    """Cells and header of rows of heights; None is nodata."""
    cells = [(name, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "raster_id string, row int, col int, v double"), spark.createDataFrame([(name, len(rows[0]), len(rows), 0.0, 0.0, cellsize, -9999.0, None)], "raster_id string, ncols int, nrows int, xll double, yll double, cellsize double, nodata double, crs string")


def shape(*lines):
    return np.array([[x == "#" for x in line] for line in lines])


@pytest.mark.parametrize("members, width", [
    (np.ones((n, n), bool), n) for n in (1, 2, 5)] + [(np.ones((2, 7), bool), 2), (np.ones((9, 3), bool), 3), (np.ones((1, 30), bool), 1),
    (shape(".#.", "###", ".#."), math.sqrt(2)), (shape("#.", "##"), 4 - 2 * math.sqrt(2))])
def test_width_of_shapes(members, width):
    for turned in (members, members.T, members[::-1], np.pad(members, 2)):
        assert 2 * openings.largest_circle(turned)[0] == pytest.approx(width, abs=1e-6)


@pytest.mark.parametrize("cellsize", [0.25, 1.0, 4.0])
def test_gaps_by_width_are_in_map_units(spark, cellsize):
    rows = [[9.0] * 14 for _ in range(9)]
    for r in range(2, 7):
        for c in range(2, 7):
            rows[r][c] = 0.5
    for c in range(7, 13):
        rows[4][c] = 1.0  # a corridor one cell wide
    cells, rasters = _grid(spark, rows, cellsize)
    whole, = raster.gaps(cells, rasters, 2.0, 0.0, with_width=True).collect()
    assert whole["cells"] == 31 and whole.width == pytest.approx(5 * cellsize, abs=1e-5)
    gap, = raster.gaps(cells, rasters, 2.0, 0.0, min_width=2 * cellsize, with_width=True).collect()
    assert gap["cells"] == 25 - 0 and gap.width == pytest.approx(5 * cellsize, abs=1e-5) and not gap.touches_edge
    far = raster.distance_field(cells, rasters).filter("row = 4 AND col = 4").first()
    assert far.distance == pytest.approx(2.5 * cellsize)


def test_opening_against_dense_sampling():
    rnd = np.random.default_rng(7)
    for _ in range(12):
        blocked = rnd.random((7, 8)) < 0.25
        radius = float(rnd.uniform(0.5, 2.0))
        got = openings.opened(blocked, radius)
        step = np.arange(0.02, 8, 0.04)
        y, x = (a.ravel() for a in np.meshgrid(step[step < 7], step, indexing="ij"))
        clear = openings.Walls(blocked).clearance(y, x)
        clear[blocked[y.astype(int), x.astype(int)]] = 0
        for r, c in zip(*np.nonzero(~blocked)):
            near = np.hypot(y - r - 0.5, x - c - 0.5)
            if (clear[near <= radius - 0.03] >= radius + 0.03).any():
                assert got[r, c]
            if not (clear[near <= radius + 0.03] >= radius - 0.03).any():
                assert not got[r, c]


def test_opening_in_blocks_is_the_same(spark, monkeypatch):
    rnd = random.Random(2)
    cells, rasters = _grid(spark, [[rnd.choice((1.0, 1.0, 1.0, 1.0, 9.0, None)) for _ in range(30)] for _ in range(26)])
    want = sorted((r.row, r.col) for r in openings.opened_cells(cells, rasters, 2.0, 1.3).collect())
    monkeypatch.setattr(openings, "TILE", 7)
    assert want and sorted((r.row, r.col) for r in openings.opened_cells(cells, rasters, 2.0, 1.3).collect()) == want


def test_simplex_finds_a_valley():
    found = fitting.simplex(lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, (-1.2, 1.0))
    assert found.converged and np.allclose(found.x, (1, 1), atol=1e-4)
    assert fitting.simplex(lambda x: math.log(x[0]) ** 2, (2.0,)).x[0] == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("family", ["naslund", "power", "curtis", "chapman"])
def test_parameters_are_recovered(family):
    true = {"naslund": (1.6, 0.19), "power": (2.4, 0.55), "curtis": (27.0, 5.0), "chapman": (28.0, 0.05, 1.3)}[family]
    d = np.linspace(5, 60, 40)
    h = curves.CURVES[family].array(d, true)
    fit = fitting.fit_pairs(d, h, family)
    assert np.allclose(fit["params"], true, rtol=1e-2) and fit["rmse"] < 1e-2 and fit["r2"] > 0.9999
    order = np.random.default_rng(1).permutation(40)
    assert fitting.fit_pairs(d[order], h[order], family)["params"] == fit["params"]
    with pytest.raises(ValueError):
        fitting.fit_pairs(d[:3], h[:3], family)


def test_curves_by_species_with_fallback(spark):
    naslund = lambda d, a, b: 1.3 + (d / (a + b * d)) ** 2
    rows = [(f"p{i}", 1, " piab", "live", 10.0 + i, naslund(10.0 + i, 1.3, 0.168), 0.0, 0.0) for i in range(12)] + [("q", 1, "FASY", "live", 20.0, 50.0, 0.0, 0.0), ("r", 2, "FASY", "live", 20.0, 18.0, 0.0, 0.0), ("s", 2, "", "dead", 20.0, 18.0, 0.0, 0.0)]
    trees = _trees(spark, rows)
    models = {(r.plot_id, r.species): r for r in fitting.fit_by_species(trees).collect()}
    assert set(models) == {(1, "PIAB"), (1, ""), (2, "")} and models[1, "PIAB"].n == 12 and models[1, ""].n == 13
    assert np.allclose(models[1, "PIAB"].params, (1.3, 0.168), atol=1e-4)
    assert (models[2, ""].n, models[2, ""].rmse, models[2, ""].params) == (0, None, [1.4, 0.17])
    plots = spark.createDataFrame([(1, 1.0), (2, 1.0)], "plot_id long, area_ha double")
    found = rules.inspect(rules.Context(trees, plots), [rules.height_anomalies]).collect()
    assert found == [] or all(f.code == "SV030" for f in found)


def test_plots_are_matched_apart(spark):
    a = spark.createDataFrame([(k, "D1", 0.0, 0.0) for k in (1, 2)], "plot_id long, a_id string, ax double, ay double")
    b = spark.createDataFrame([(k, "T1", 1.0, 0.0) for k in (1, 2)], "plot_id long, b_id string, bx double, by double")
    assert sorted(r.plot_id for r in matching.match_pairs(matching.range_join(a, b, 2.5)).collect()) == [1, 2]


def test_unlike_rasters_do_not_combine(spark):
    a, b = _grid(spark, [[1.0, 2.0]])[0], _grid(spark, [[1.0], [2.0]])[0]
    with pytest.raises(Exception, match="differ in shape"):
        raster.combined(a, b, lambda x, y: x + y).collect()


def test_extents_by_plot(spark):
    trees = _trees(spark, [("a", 1, "X", "live", 1.0, 1.0, 5.0, 5.0), ("b", 2, "X", "live", 1.0, 1.0, 5.0, 5.0)])
    plots = spark.createDataFrame([(1, 1.0), (2, 1.0)], "plot_id long, area_ha double")
    extent = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0), (2, 6.0, 6.0, 9.0, 9.0)], "plot_id long, xmin double, ymin double, xmax double, ymax double")
    assert [f.plot_id for f in rules.inspect(rules.Context(trees, plots, extent), [rules.coordinates_in_extent]).collect()] == [2]
    with pytest.raises(Exception, match="several extents"):
        rules.inspect(rules.Context(trees, plots, extent.drop("plot_id")), [rules.coordinates_in_extent]).collect()


def test_gini_of_nothing_is_zero(spark):
    trees = _trees(spark, [(str(i), 1, "X", "live", 1e-170, 1.0, 0.0, 0.0) for i in range(3)])
    assert inv.gini(trees).first().gini == 0.0


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_components_in_one_block_or_several(spark, monkeypatch, block):
    from groveline.operators import graph

    monkeypatch.setattr(graph, "BLOCK", block)
    rnd = random.Random(4)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(30)]
    top = list(range(40))
    for _ in range(40):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    want = sorted((i, top[i]) for i in {x for a, b in edges if a != b for x in (a, b)})
    plain = spark.createDataFrame(edges, "a int, b int")
    assert sorted(tuple(r) for r in graph.components(plain).collect()) == want
    nested = plain.selectExpr("named_struct('r', 1, 'c', a) AS a", "named_struct('r', 1, 'c', b) AS b")
    assert sorted((r.id.c, r.component.c) for r in graph.components(nested).collect()) == want
