"""GeoTIFF rasters: classic TIFF, one band, north up, square cells; read exactly or refused, written without loss."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: field types (struct code), tags and keys.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, BANDS, STRIP_ROWS, STRIP_SIZE = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, MATRIX, KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED, LINEAR_UNIT, METRE, USER_DEFINED = 1024, 1025, 2048, 3072, 3076, 9001, 32767
# Codes of systems in degrees that are met where a projected one is due.
GEOGRAPHIC_CODES = (4326, 4258, 4269, 4979, 4937)
DEFAULT_NODATA = -9999.0
MOST_CELLS = 50_000_000


class TiffError(ValueError):
    """A file that is broken, or of a kind that isn't read."""


def _directory(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the values of each tag of the first directory."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    version, at = struct.unpack(order + "HI", data[2:8])
    if version != 42:
        raise TiffError("unsupported: BigTIFF" if version == 43 else "not a TIFF file")
    tags: dict[int, tuple] = {}
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(n):
            tag, kind, count, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * k)
            if tag in tags:
                raise TiffError(f"corrupt TIFF: tag {tag} is given twice")
            if kind not in TYPES:
                continue
            code = TYPES[kind]
            size = struct.calcsize("<" + code) * count
            place = at + 10 + 12 * k
            if size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + size > len(data):
                raise TiffError(f"corrupt TIFF: tag {tag} lies beyond the end")
            tags[tag] = (data[place : place + count],) if code == "s" else struct.unpack_from(order + code * count, data, place)
    except struct.error as e:
        raise TiffError("corrupt TIFF: the directory is cut off") from e
    return order, tags


def _one(tags: dict[int, tuple], tag: int, default: int | None = None) -> int:
    found = tags.get(tag, (default,))
    if len(found) != 1 or not isinstance(found[0], int):
        raise TiffError(f"corrupt TIFF: tag {tag} needs one whole number")
    return found[0]


def _unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def _inflate(data: bytes, how: int, size: int) -> bytes:
    if how == 1:
        out = data
    elif how == 32773:
        out = _unpackbits(data, size)
    elif how in (8, 32946):
        try:
            out = zlib.decompressobj().decompress(data, size)  # never more than the segment may hold
        except zlib.error as e:
            raise TiffError("corrupt TIFF: a segment can't be inflated") from e
    else:
        raise TiffError(f"unsupported: compression {how}")
    if len(out) < size:
        raise TiffError("corrupt TIFF: a segment is too short")
    return out[:size]


def _segment(raw: bytes, rows: int, cols: int, kind: np.dtype, predictor: int, order: str) -> np.ndarray:
    size = kind.itemsize
    if predictor == 3:
        if kind.kind != "f":
            raise TiffError("unsupported: predictor 3 on whole numbers")
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, cols * size), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(rows, size, cols).transpose(0, 2, 1)).view(kind.newbyteorder(">"))[:, :, 0].astype(kind)
    values = np.frombuffer(raw, kind.newbyteorder(order)).reshape(rows, cols)
    if predictor == 2:
        if kind.kind == "f":
            values = np.frombuffer(raw, np.dtype(f"u{size}").newbyteorder(order)).reshape(rows, cols)
            return np.cumsum(values, axis=1, dtype=f"u{size}").view(kind)
        return np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
    if predictor != 1:
        raise TiffError(f"unsupported: predictor {predictor}")
    return values.astype(kind.newbyteorder("="))


def _samples(data: bytes, order: str, tags: dict[int, tuple], rows: int, cols: int, kind: np.dtype) -> np.ndarray:
    how, predictor = _one(tags, COMPRESSION, 1), _one(tags, PREDICTOR, 1)
    tiled = TILE_AT in tags
    if tiled:
        deep, wide, at, sizes = _one(tags, TILE_HEIGHT), _one(tags, TILE_WIDTH), tags[TILE_AT], tags.get(TILE_SIZE, ())
    else:
        deep, wide, at, sizes = min(_one(tags, STRIP_ROWS, rows), rows), cols, tags.get(STRIP_AT, ()), tags.get(STRIP_SIZE, ())
    if deep < 1 or wide < 1:
        raise TiffError("corrupt TIFF: empty segments")
    down, across = -(-rows // deep), -(-cols // wide)
    if len(at) != down * across or len(sizes) != len(at):
        raise TiffError("corrupt TIFF: the number of segments is wrong")
    out = np.empty((rows, cols), kind)
    for k, (start, size) in enumerate(zip(at, sizes, strict=True)):
        if not size:
            raise TiffError("unsupported: sparse segments")
        if start + size > len(data):
            raise TiffError("corrupt TIFF: a segment lies beyond the end")
        r, c = k // across * deep, k % across * wide
        have = deep if tiled else min(deep, rows - r)
        part = _segment(_inflate(data[start : start + size], how, have * wide * kind.itemsize), have, wide, kind, predictor, order)
        out[r : r + deep, c : c + wide] = part[: rows - r, : cols - c]
    return out


def _crs(tags: dict[int, tuple]) -> tuple[str | None, bool]:
    """Reference system, and whether a pixel's place is that of its centre."""
    raw = tags.get(KEYS, ())
    if raw and (len(raw) < 4 or len(raw) < 4 + 4 * raw[3]):
        raise TiffError("corrupt TIFF: the key directory is cut off")
    keys = {raw[4 + 4 * k]: raw[7 + 4 * k] for k in range(raw[3] if raw else 0) if raw[5 + 4 * k] == 0}
    if keys.get(MODEL_TYPE) in (2, 3) or (GEOGRAPHIC in keys and PROJECTED not in keys):
        raise TiffError("unsupported CRS: degrees")
    code = keys.get(PROJECTED)
    if code is None:
        return None, keys.get(RASTER_TYPE) == 2
    if code in (0, USER_DEFINED) or code > USER_DEFINED - 1 or code in GEOGRAPHIC_CODES:
        raise TiffError(f"unsupported CRS: code {code}")
    if keys.get(LINEAR_UNIT, METRE) != METRE:
        raise TiffError("unsupported CRS: the unit is not the metre")
    return f"EPSG:{code}", keys.get(RASTER_TYPE) == 2


def _place(tags: dict[int, tuple], world: str | None, rows: int, centre: bool) -> tuple[float, float, float]:
    """West and south edge, and cell size."""
    if MATRIX in tags:
        m = tags[MATRIX]
        if len(m) != 16 or m[1] or m[4]:
            raise TiffError("unsupported: a rotated raster")
        size, other, x, y = m[0], -m[5], m[3], m[7]
    elif SCALE in tags and TIEPOINT in tags:
        if len(tags[SCALE]) < 2 or len(tags[TIEPOINT]) != 6:
            raise TiffError("unsupported: georeferencing by several points")
        size, other = tags[SCALE][:2]
        i, j, _, x, y, _ = tags[TIEPOINT]
        x, y = x - i * size, y + j * other
    elif {SCALE, TIEPOINT, KEYS} & set(tags):
        raise TiffError("corrupt TIFF: georeferencing is incomplete")
    elif world is not None:
        try:
            size, turn, lean, other, x, y = map(float, world.split())
        except ValueError as e:
            raise TiffError("a world file needs six numbers") from e
        if turn or lean:
            raise TiffError("unsupported: a rotated raster")
        other, centre = -other, True
    else:
        raise TiffError("no georeferencing")
    if not all(map(np.isfinite, (size, other, x, y))) or size <= 0 or abs(size - other) > 1e-9 * size:
        raise TiffError("unsupported: cells that aren't square and north up")
    if centre:
        x, y = x - size / 2, y + size / 2
    return float(x), float(y - rows * size), float(size)


def parse_tiff(data: bytes, world: str | None = None) -> dict:
    """Header and row-major values of one file; ``world``: the text of its world file, used if it has no tags of place."""
    order, tags = _directory(data)
    rows, cols = _one(tags, HEIGHT), _one(tags, WIDTH)
    if rows < 1 or cols < 1 or rows * cols > MOST_CELLS:
        raise TiffError(f"{rows} x {cols} cells: there must be 1 to {MOST_CELLS}")
    if _one(tags, BANDS, 1) != 1:
        raise TiffError("unsupported: several bands")
    if METADATA in tags and re.search(rb"<Item[^>]*name=\"(?:SCALE|OFFSET)\"", tags[METADATA][0]):
        raise TiffError("unsupported: scaled values")
    bits, form = _one(tags, BITS, 1), _one(tags, FORMAT, 1)
    if (form, bits) not in {(f, b) for f in (1, 2) for b in (8, 16, 32, 64)} | {(3, 32), (3, 64)}:
        raise TiffError(f"unsupported: samples of {bits} bits, format {form}")
    crs, centre = _crs(tags)
    west, south, size = _place(tags, world, rows, centre)
    raw = _samples(data, order, tags, rows, cols, np.dtype(f"{'uif'[form - 1]}{bits // 8}")).ravel()
    nodata, gone = DEFAULT_NODATA, raw == DEFAULT_NODATA
    if NODATA in tags:
        text = tags[NODATA][0].rstrip(b"\0").decode("ascii", "replace").strip()
        try:
            value = int(text) if form != 3 and re.fullmatch(r"[+-]?\d+", text) else float(text)
        except ValueError as e:
            raise TiffError(f"corrupt TIFF: nodata is {text!r}") from e
        if np.isfinite(value):
            nodata, gone = float(value), raw == (np.float32(value) if (form, bits) == (3, 32) else value)
        else:
            gone = np.isnan(raw) if np.isnan(value) else raw == value
    if form != 3 and bits == 64 and (np.abs(raw[~gone].astype(float)) > 2.0**53).any():
        raise TiffError("unsupported: whole numbers beyond 2**53")
    values = raw.astype(float)
    if not np.isfinite(values[~gone]).all():
        raise TiffError("values must be finite")
    if ((values == nodata) & ~gone).any():
        raise TiffError("a value equals the nodata value of the raster")
    return {"ncols": cols, "nrows": rows, "xll": west, "yll": south, "cellsize": size, "nodata": nodata, "crs": crs, "v": [None if g else x for x, g in zip(values.tolist(), gone.tolist(), strict=True)]}


def tiff_bytes(head: dict, values: np.ndarray) -> bytes:
    """An uncompressed file of one strip: 32-bit floats if all values are exactly such, else 64-bit; nan is nodata. The same input gives the same bytes."""
    rows, cols, nodata = int(head["nrows"]), int(head["ncols"]), float(head["nodata"])
    flat = np.asarray(values, float).reshape(rows * cols)
    if (flat == nodata).any():
        raise TiffError("a value reads back as nodata")
    flat = np.where(np.isnan(flat), nodata, flat)
    if not np.isfinite(flat).all():
        raise TiffError("values must be finite")
    with np.errstate(over="ignore"):
        kind = "<f4" if (flat.astype("<f4").astype(float) == flat).all() else "<f8"
    body = flat.astype(kind).tobytes()
    north = float(head["yll"]) + rows * float(head["cellsize"])
    keys = [(RASTER_TYPE, 1)]
    if head.get("crs"):
        code = int(str(head["crs"]).removeprefix("EPSG:"))
        keys = [(MODEL_TYPE, 1), (RASTER_TYPE, 1), (PROJECTED, code)]
    directory = [1, 1, 0, len(keys), *(x for k, v in keys for x in (k, 0, 1, v))]
    text = repr(nodata).encode() + b"\0"
    size = float(head["cellsize"])
    entries = [(WIDTH, "I", [cols]), (HEIGHT, "I", [rows]), (BITS, "H", [8 * int(kind[2])]), (COMPRESSION, "H", [1]), (262, "H", [1]), (STRIP_AT, "I", [0]), (BANDS, "H", [1]), (STRIP_ROWS, "I", [rows]), (STRIP_SIZE, "I", [len(body)]), (FORMAT, "H", [3]),
               (SCALE, "d", [size, size, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, float(head["xll"]), north, 0.0]), (KEYS, "H", directory), (NODATA, "s", text)]
    end = 8 + 2 + 12 * len(entries) + 4
    extra, table = b"", b""
    for tag, code, value in entries:
        packed = value if code == "s" else struct.pack(f"<{len(value)}{code}", *value)
        number = {v: k for k, v in TYPES.items() if k not in (7,)}[code]
        if len(packed) > 4:
            place = struct.pack("<I", end + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            place = packed.ljust(4, b"\0")
        table += struct.pack("<HHI", tag, number, len(value)) + (b"STRP" if tag == STRIP_AT else place)
    table = table.replace(b"STRP", struct.pack("<I", end + len(extra)), 1)
    return b"II" + struct.pack("<HIH", 42, 8, len(entries)) + table + b"\0\0\0\0" + extra + body


_SCHEMA = "raster_id string, ncols int, nrows int, xll double, yll double, cellsize double, nodata double, crs string, v array<double>"


def read_tiffs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rasters, cells) of the .tif and .tiff files at ``path``; a .tfw beside a file without tags of place stands in for them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT]*").load(path)
    stem, suffix = F.regexp_extract("path", r"^(.*)\.[^./]*$", 1), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    files = files.select(stem.alias("stem"), suffix.alias("suffix"), F.col("path"), "content")
    worlds = files.filter("suffix = 'tfw'").groupBy("stem").agg(F.max_by(F.col("content").cast("string"), "path").alias("world"))  # .tfw before .TFW
    tiffs = files.filter("suffix IN ('tif', 'tiff')").join(worlds, "stem", "left").select(F.regexp_extract("stem", r"([^/]*)$", 1).alias("raster_id"), "content", "world")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content, world in zip(batch["raster_id"], batch["content"], batch["world"], strict=True):
                try:
                    yield pd.DataFrame([{"raster_id": name} | parse_tiff(bytes(content), world if isinstance(world, str) else None)])
                except TiffError as e:
                    raise TiffError(f"{name}: {e}") from e

    grids = tiffs.mapInPandas(parse, _SCHEMA)
    every = grids.select("raster_id", "ncols", F.posexplode("v").alias("at", "v"))
    cells = every.select("raster_id", F.expr("cast(at div ncols AS int)").alias("row"), (F.col("at") % F.col("ncols")).cast("int").alias("col"), "v")
    return grids.drop("v"), cells


def tiff_files(rasters: DataFrame, cells: DataFrame) -> DataFrame:
    """(raster_id, content): the bytes of each raster's file. A raster is a task."""
    whole = cells.join(rasters, "raster_id")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        head = part.iloc[0].to_dict()
        v = np.full((int(head["nrows"]), int(head["ncols"])), np.nan)
        v[part["row"], part["col"]] = part["v"].astype(float)
        return pd.DataFrame({"raster_id": [head["raster_id"]], "content": [tiff_bytes(head, v)]})

    return whole.groupBy("raster_id").applyInPandas(build, "raster_id string, content binary")
