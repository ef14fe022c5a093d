import numpy as np
import pytest

from groveline.operators import crowns, raster
from groveline.sources import grids, inventories

GRID = "NCOLS 3\nnrows 2\nxllcenter 10.5\nyllcorner 20\ncellsize 1\nNODATA_value -1\n1 2.5 -1\n4\n5 6\n"


def test_grid_round_trip(spark, tmp_path):
    (tmp_path / "a.asc").write_text(GRID)
    rasters, cells = grids.read_grids(spark, str(tmp_path))
    head = rasters.first()
    assert (head.raster_id, head.ncols, head.nrows, head.xll, head.yll, head.nodata) == ("a", 3, 2, 10.0, 20.0, -1.0)
    got = {(r.row, r.col): r.v for r in cells.collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.5, (0, 2): None, (1, 0): 4.0, (1, 1): 5.0, (1, 2): 6.0}
    again = grids.parse_grid(grids.grid_texts(rasters, cells).first().value)
    assert again["v"] == [1.0, 2.5, None, 4.0, 5.0, 6.0] and again["xll"] == 10.0
    grids.write_grids(rasters, cells, str(tmp_path / "out"))


@pytest.mark.parametrize("bad", ["ncols 1\nnrows 1\n1", "ncols 1\nncols 1\nnrows 1\ncellsize 1\n1", "ncols 1\nnrows 1\ncellsize 1\n1 2", "ncols 1\nnrows 1\ncellsize 1\nnan", "ncols 1.5\nnrows 1\ncellsize 1\n1", "ncols 1\nnrows 1\ncellsize 0\n1", "ncols 1 2\nnrows 1\ncellsize 1\n1"])
def test_bad_grids_are_refused(bad):
    with pytest.raises(ValueError):
        grids.parse_grid(bad)


def test_inventory_round_trip(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Easting,Y,DBH,Sp,id,ht\n1,2,30.5,"PI,AB",,NA\n,,,,,\n3,4,-,FA,1,20\n5,6\n')
    got = inventories.read_inventories(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r.plot_id, r.tree_id, r.x, r.y, r.species, r.dbh_cm, r.height_m, r.status) for r in got] == [
        ("p", "2", 1.0, 2.0, "PI,AB", 30.5, None, "live"), ("p", "1", 3.0, 4.0, "FA", None, 20.0, "live"), ("p", "3", 5.0, 6.0, "", None, None, "live")]
    trees = spark.createDataFrame(got, inventories.SCHEMA)
    inventories.write_inventories(trees, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("x")
    assert back.columns[:8] == list(inventories.COLUMNS) and [r.tree_id for r in back.collect()] == ["2", "1", "3"]


@pytest.mark.parametrize("bad", ["", "x,dbh\n1,2", "x,y,easting\n1,2,3", "x,y\n1,2,3", "x,y\n1,abc", "x,y,dbh\n1,2,inf", "x,y\n1,"])
def test_bad_inventories_are_refused(bad):
    with pytest.raises(ValueError):
        inventories.parse_inventory(bad)


def test_crowns(spark):
    """Two cones and a plateau: a top for each, no crown over another, cells within reach and above the floor."""
    row, col = np.mgrid[0:24, 0:24]
    high = np.maximum.reduce([20 - 2.5 * np.hypot(row - 6, col - 6), 15 - 2 * np.hypot(row - 16, col - 17), np.zeros((24, 24))])
    high[2:4, 18:20] = 9.0
    cells = spark.createDataFrame([("r", int(r), int(c), float(high[r, c])) for r in range(24) for c in range(24)], "raster_id string, row int, col int, v double")
    rasters = spark.createDataFrame([("r", 24, 24, 0.0, 0.0, 0.5, -9999.0, None)], "raster_id string, ncols int, nrows int, xll double, yll double, cellsize double, nodata double, crs string")
    tops = crowns.treetops(raster.treetop_candidates(cells, rasters))
    assert [(r.label, r.row, r.col) for r in tops.orderBy("label").collect()] == [(1, 6, 6), (2, 16, 17), (3, 2, 18)]
    grown = crowns.crown_cells(cells, rasters, tops).collect()
    assert len({(r.row, r.col) for r in grown}) == len(grown)
    at = {1: (6, 6, 20.0), 2: (16, 17, 15.0), 3: (2, 18, 9.0)}
    for r in grown:
        y, x, top = at[r.label]
        assert r.v >= 0.45 * top and np.hypot(r.row - y, r.col - x) * 0.5 <= 1 + 0.1 * top
    out = crowns.detect_trees(cells, rasters, smooth=0).orderBy("crown_id").collect()
    assert [r.height for r in out] == [20.0, 15.0, 9.0] and out[2].cells == 4 and out[2].area == 1.0
