import io
import json
import math
import struct
import zlib

import numpy as np
import pytest

from groveline import cli
from groveline.operators import crowns, inventory, matching
from groveline.plans import report
from groveline.sources import geotiff, rasters, stands

HEAD = {"ncols": 4, "nrows": 3, "xll": 100.0, "yll": 200.0, "cellsize": 0.5, "nodata": -9999.0, "crs": "EPSG:3067"}


def test_tiff_round_trip():
    v = np.array([[1.5, np.nan, 2.25, 3.0], [0.0, -1.0, 7.75, 8.0], [0.1, 0.2, np.nan, 1e9]])
    for values, bits in ((v, 64), (np.round(v * 4) / 4, 32)):
        data = geotiff.tiff_bytes(HEAD, values)
        back = geotiff.parse_tiff(data)
        assert {k: back[k] for k in HEAD} == HEAD
        assert [x if x is None else float(x) for x in back["v"]] == [None if math.isnan(x) else x for x in values.ravel().tolist()]
        assert geotiff._directory(data)[1][geotiff.BITS] == (bits,) and geotiff.tiff_bytes(HEAD, values) == data
    with pytest.raises(geotiff.TiffError):
        geotiff.tiff_bytes(HEAD, np.full((3, 4), -9999.0))


def build(order, kind, values, *, tile=None, how=1, predictor=1, tags=(), place=True):
    """A file as the format describes it, made apart from the writer."""
    rows, cols = values.shape
    deep, wide = tile or (2, cols)
    blocks = []
    for r in range(0, rows, deep):
        for c in range(0, cols, wide):
            part = values[r : r + deep, c : c + wide]
            if tile:
                part = np.pad(part, ((0, deep - part.shape[0]), (0, wide - part.shape[1])))
            part = part.astype(kind)
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), kind)).astype(kind)
            raw = part.astype(np.dtype(kind).newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = part.astype(np.dtype(kind).newbyteorder(">")).view(np.uint8).reshape(*part.shape, -1).transpose(0, 2, 1).reshape(len(part), -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).astype(np.uint8).tobytes()
            if how == 8:
                raw = zlib.compress(raw)
            if how == 32773:
                raw = b"".join(bytes([len(raw[k : k + 100]) - 1]) + raw[k : k + 100] for k in range(0, len(raw), 100))
            blocks.append(raw)
    form = {"u": 1, "i": 2, "f": 3}[np.dtype(kind).kind]
    entries = [(256, "I", [cols]), (257, "I", [rows]), (258, "H", [np.dtype(kind).itemsize * 8]), (259, "H", [how]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [form]), *tags]
    if place:
        entries += [(33550, "d", [1.0, 1.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 10.0, 50.0, 0.0])]
    entries += [(322, "I", [wide]), (323, "I", [deep]), (324, "I", None), (325, "I", list(map(len, blocks)))] if tile else [(278, "I", [deep]), (273, "I", None), (279, "I", list(map(len, blocks)))]
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    entries.sort(key=lambda e: e[0])
    at, extra, table = 8 + 2 + 12 * len(entries) + 4, b"", b""
    sizes = sum(8 * 0 + (struct.calcsize(c) * len(v if v is not None else blocks) if c != "s" else len(v)) for _, c, v in entries)
    starts, place_at = [], at + sizes + 64
    for b in blocks:
        starts.append(place_at)
        place_at += len(b)
    for tag, code, value in entries:
        value = starts if value is None else value
        packed = value if code == "s" else struct.pack(order + code * len(value), *value)
        head = struct.pack(order + "HHI", tag, codes[code], len(value))
        if len(packed) > 4:
            head += struct.pack(order + "I", at + len(extra))
            extra += packed
        else:
            head += packed.ljust(4, b"\0")
        table += head
    data = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(entries)) + table + b"\0" * 4 + extra
    return data.ljust(starts[0], b"\0") + b"".join(blocks)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (2, 3)])
@pytest.mark.parametrize("how", [1, 8, 32773])
@pytest.mark.parametrize("kind, predictor", [("u1", 1), ("i2", 2), ("u4", 2), ("i8", 1), ("f4", 1), ("f4", 3), ("f8", 3)])
def test_tiffs_of_many_kinds(order, tile, how, kind, predictor):
    values = np.arange(20).reshape(4, 5) * 3
    got = geotiff.parse_tiff(build(order, kind, values, tile=tile, how=how, predictor=predictor))
    assert got["v"] == values.ravel().astype(float).tolist() and (got["xll"], got["yll"], got["cellsize"]) == (10.0, 46.0, 1.0)


def test_tiffs_that_are_refused():
    v = np.arange(6).reshape(2, 3)
    good = build("<", "f4", v)
    for bad in (b"", b"II", good[:40], b"XX" + good[2:], build("<", "f4", v, how=5), build("<", "u1", v, predictor=3), build("<", "f4", v, tags=[(34735, "H", [1, 1, 0, 1, 1024, 0, 1, 2])]),
                build("<", "f4", v, place=False), build("<", "f4", v, tags=[(42112, "s", b'<Item name="SCALE">2</Item>\0')]), build("<", "f4", v, tags=[(42113, "s", b"x\0")])):
        with pytest.raises(geotiff.TiffError):
            geotiff.parse_tiff(bad)
    assert geotiff.parse_tiff(build("<", "f4", v, tags=[(42113, "s", b"3\0")]))["v"][3] is None
    assert geotiff.parse_tiff(build("<", "f4", v, place=False), "2 0 0 -2 11 49")["xll"] == 10.0


def test_rasters_by_suffix(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown raster suffix"):
        rasters.read_raster(spark, "/nowhere/chm.txt")
    (tmp_path / "a.tif").write_bytes(build("<", "i2", np.arange(6).reshape(2, 3)))
    (tmp_path / "b.tif").write_bytes(build("<", "i2", np.arange(6).reshape(2, 3), place=False))
    (tmp_path / "b.tfw").write_text("1\n0\n0\n-1\n0.5\n1.5\n")
    heads, cells = geotiff.read_tiffs(spark, str(tmp_path))
    assert {r.raster_id: (r.xll, r.yll) for r in heads.collect()} == {"a": (10.0, 48.0), "b": (0.0, 0.0)}
    assert sorted((r.row, r.col, r.v) for r in cells.filter("raster_id = 'a'").collect()) == [(i // 3, i % 3, float(i)) for i in range(6)]
    one = rasters.read_raster(spark, str(tmp_path / "a.tif"))
    assert geotiff.parse_tiff(bytes(geotiff.tiff_files(*one).first().content))["v"] == [float(i) for i in range(6)]


def test_ranks_turn_with_the_raster():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        v = rnd.integers(0, 3, (rnd.integers(1, 5), rnd.integers(1, 5))).astype(float)
        v[rnd.random(v.shape) < 0.2] = np.nan
        rank = crowns.canonical_rank(v)
        for k in range(4):
            assert (crowns.canonical_rank(np.rot90(v, k)) == np.rot90(rank, k)).all()
            assert (crowns.canonical_rank(np.rot90(v.T, k)) == np.rot90(rank.T, k)).all()


def test_growth_follows_its_rule():
    v = np.array([[9.0, 8, 7, 6, 5], [8, 7, 6, 5, 4], [1, 1, 1, 6, 7]])
    labels = crowns._grow(v, [(1, 0, 0), (2, 2, 4)], 1.0, 2.0, 0.45, 1.0, 0.5)
    assert labels[0, 0] == 1 and labels[2, 4] == 2 and (labels[2, :3] == 0).all() and set(np.unique(labels)) == {0, 1, 2}
    assert crowns._grow(np.array([[3.0, 9.0, np.nan]]), [(1, 0, 0)], 1.0, 2.0, 0.1, 5.0, 0.0).tolist() == [[1, 0, 0]]


def test_a_made_up_stand_is_found_again(spark):
    trees, heads, cells = stands.synthesize(spark, [11], stands.Stand(60.0, 60.0, stems_per_ha=140.0, gaps=0, surface_noise=0.0))
    found = crowns.inventory_of(crowns.detect_trees(cells.select("raster_id", "row", "col", "v"), heads), heads, family="naslund", params=(1.45, 0.178))
    a = found.selectExpr("plot_id", "tree_id AS a_id", "x AS ax", "y AS ay", "height_m AS a_height")
    b = trees.selectExpr("plot_id", "tree_id AS b_id", "x AS bx", "y AS by", "height_m AS b_height")
    got = matching.match_summary(matching.match_pairs(matching.range_join(a, b, 2.5)), a, b).first()
    assert got.recall > 0.9 and got.precision > 0.9 and got.height_rmse_m < 1.5 and got.mean_offset_m < 1.0
    assert inventory.paired(found).count() > 0


def test_numbers_print_apart():
    assert report.compared(0.601, 0.6) == ("0.601", "0.600") and report.compared(1.0, 1.0) == ("1.00", "1.00")
    assert report.rounded(float("nan"), 2) is None and report.number(None) == "n/a"
    assert report.ascii_map([[0.0, 10.0], [None, 5.0]], 2, markers={(0, 1): "^"}, aspect=1.0).splitlines()[:2] == [" ^", "?+"]


def test_command_line(spark, tmp_path, capsys):
    out = tmp_path / "stand"
    assert cli.main(["synth", "--out", str(out), "--width", "30", "--height", "30", "--gaps", "1"], spark) == 0
    assert cli.main(["metrics", str(out / "trees.csv"), "--area-ha", "0.09", "--json"], spark) == 0
    assert json.load(io.StringIO(capsys.readouterr().out))[0]["tree_count"] > 5
    assert cli.main(["inspect", "--chm", str(out / "chm.asc"), "--inventory", str(out / "trees.csv"), "--format", "json"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["metrics_source"] == "field" and found["match"]["recall"] > 0.5 and "gaps" in found
    assert cli.main(["render", str(out / "chm.asc"), "--width", "20"], spark) == 0
    assert cli.main(["metrics", str(out / "trees.csv"), "--area-ha", "0"], spark) == 2
    assert cli.main(["inspect"], spark) == 2
