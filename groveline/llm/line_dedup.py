"""Fuzzy line deduplication: MinHash of character shingles, bands, exact Jaccard, one line per component.

A line's signature is a one-permutation MinHash (every shingle falls into one of the bins, empty bins
borrow from bins drawn at random for them), so each character is hashed once however long the signature is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm import _words as W
from groveline.llm._links import PACKED, Packer, link, most_bits, parts
from groveline.llm._shared import cut, read_table, release, repeats, slices

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 21, 5
#: Bins of the signature that the bands are cut from; bits of the parity bitmap of the whole set that sifts candidates.
BINS, BITS = 128, 1024
#: Bins that an empty one tries to borrow from.
BORROW = 64
#: Ids a task remembers in order to send a frequent line once; past that it starts afresh, and later steps drop repeats.
SEEN = 1 << 19
_BLANK = " \t\n\v\f\r"
_FULL = np.uint64(2**64 - 1)


def lines_of(text: str | None) -> list[str]:
    """Lines between ``\\n``; those without a word are never compared and never removed."""
    return (text or "").split("\n")


def line_id(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def _shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``SHINGLE`` consecutive code points of each line (a shorter line is one shingle), and its line."""
    sizes = np.array([len(x) for x in lines])
    padded = "".join(x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines)
    sizes = np.maximum(sizes, SHINGLE)
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points[: len(points) - SHINGLE + 1].astype(np.uint64)
    for i in range(1, SHINGLE):
        low *= np.uint64(0xD6E8FEB86659FD93)
        low += points[i : len(points) - SHINGLE + 1 + i]
    inside = np.ones(len(low) + SHINGLE - 1, bool)
    for i in range(1, SHINGLE):
        inside[np.cumsum(sizes) - i] = False
    low, of = low[inside[: len(low)]], np.repeat(np.arange(len(lines)), sizes - SHINGLE + 1)
    low ^= low >> np.uint64(32)
    low *= np.uint64(0xBF58476D1CE4E5B9)
    low ^= low >> np.uint64(29)
    return low, of


@lru_cache(1)
def _lenders() -> np.ndarray:
    """For each attempt and bin, another bin to borrow from, at random but fixed."""
    return (W.mix(np.arange(BORROW * BINS, dtype=np.uint64), 5) % np.uint64(BINS)).astype(np.int64).reshape(BORROW, BINS)


def _signatures(low: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The least hash in each bin of each line. An empty bin borrows from bins drawn for it, so that the rows of a band stay independent."""
    bins = np.full(n * BINS, _FULL)
    np.minimum.at(bins, of * BINS + (low & np.uint64(BINS - 1)).astype(np.int64), low)
    own = bins.copy()
    empty = np.flatnonzero(bins == _FULL)
    base, column = empty - empty % BINS, empty % BINS
    for lender in _lenders():
        if not len(empty):
            break
        value = own[base + lender[column]]
        bins[empty] = value
        rest = value == _FULL
        empty, base, column = empty[rest], base[rest], column[rest]
    if len(empty):  # none of its lenders had any: the line's least
        bins[empty] = own.reshape(n, BINS).min(1)[empty // BINS]
    return W.mix(bins.reshape(n, BINS) ^ W.mix(np.arange(BINS, dtype=np.uint64), 3))


def _parity(low: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each line's set, and the parity bitmap of its members."""
    # Sorted as one number, line before hash; a part has fewer than 2**24 lines, so the upper 40 bits of the hash are always there.
    shift = np.uint64(max(1, (n - 1).bit_length()))
    key = (of.astype(np.uint64) << (np.uint64(64) - shift)) | (low >> shift)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    sizes = np.bincount((key >> (np.uint64(64) - shift)).astype(np.int64), minlength=n)
    # The line and the upper bits of the hash, next to each other in the key, are the place of the bit.
    odd = np.bincount((key >> (np.uint64(64 - BITS.bit_length() + 1) - shift)).astype(np.int64), minlength=n * BITS) & 1
    return sizes, np.packbits(odd.astype(np.uint8).reshape(n, BITS), axis=1).view(np.int64)


def _bands(bins: np.ndarray) -> np.ndarray:
    bands = bins[:, 0 : BANDS * ROWS : ROWS].copy()
    for r in range(1, ROWS):
        bands = W.mix(bands ^ bins[:, r : BANDS * ROWS : ROWS], 7)
    return W.mix(bands ^ np.arange(BANDS, dtype=np.uint64), 11)


def _parts(lines: list[str], most: int = 1 << 18) -> Iterator[list[str]]:
    part, size = [], 0
    for x in lines:
        part.append(x)
        size += len(x)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """line, doc_id, first line number, and how often, for each distinct line of a document with a word."""
    for batch in slices(batches, "text"):
        out: tuple[list, list, list] = ([], [], [])
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for line in dict.fromkeys(lines_of(text)):
                if line.strip(_BLANK):
                    out[0].append(line_id(line))
                    out[1].append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["line", "doc_id"])


def _packed(n: int):
    """Packed bands of the lines, each line once a task while its ids are fewer than ``SEEN``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        packer = Packer(n)
        for batch in slices(batches, "text"):
            every = {line_id(x): x for t in batch.column(0).to_pylist() for x in dict.fromkeys(lines_of(t)) if x.strip(_BLANK)}
            fresh = {x: i for i, x in every.items() if i not in seen}
            seen = seen if len(seen) < SEEN else set()
            seen.update(every)
            for lines in _parts(list(fresh)):
                low, of = _shingles(lines)
                yield from packer.add(_bands(_signatures(low, of, len(lines))), np.array([fresh[x] for x in lines], np.int64))
        yield packer.flush()

    return pack


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, bitmap and the line itself of the wanted lines; columns text, wanted (ids)."""
    for batch in slices(batches, "text"):
        found: dict[str, int] = {}
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            wanted = set(wanted)
            for line in dict.fromkeys(lines_of(text)):
                if line.strip(_BLANK) and (own := line_id(line)) in wanted:
                    found[line] = own
        for lines in _parts(list(found), 1 << 17):
            low, of = _shingles(lines)
            n, odd = _parity(low, of, len(lines))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(odd.reshape(-1)), odd.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([found[x] for x in lines], pa.int64()), pa.array(n, pa.int64()), lists, pa.array(lines, pa.string())], names=["id", "n", "odd", "body"])


def _set(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similar(a: set[str], b: set[str]) -> bool:
    """Whether the Jaccard similarity is high enough, counted on the shingles themselves."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


class Shingles:
    """A line's distinct shingles as sorted numbers, 12 bits a code point; None where a code point has more bits."""

    def __init__(self, line: str):
        self.line, self.codes = line, None
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(points) and points.max() >> np.uint64(12):
            return
        n = min(len(points), SHINGLE)
        # A line shorter than a shingle differs from any shingle by its length in the upper bits.
        codes = np.zeros(len(points) - n + 1, np.uint64)
        for i in range(n):
            codes = (codes << np.uint64(12)) | points[i : len(points) - n + 1 + i]
        if n < SHINGLE:
            codes |= np.uint64(n << 60)
        codes.sort()
        self.codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])]


def alike(a: Shingles, b: Shingles) -> bool:
    """``similar``, exactly, by the numbers of the shingles where both lines have them."""
    if a.codes is None or b.codes is None:
        return similar(_set(a.line), _set(b.line))
    a, b = a.codes, b.codes
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int(np.count_nonzero(a[at] == b))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, found (line, its component if it goes by that here, else null: it is kept elsewhere), and any carried."""
    for batch in slices(batches, "text"):
        total, removed, kept = [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            at = {f["line"]: f["root"] for f in found or ()}
            seen, left = set(), []
            n = gone = 0
            for line in lines_of(text):
                if not line.strip(_BLANK):
                    left.append(line)
                    continue
                n += 1
                # Where nothing was found a line needs no id to be told from others.
                own = line_id(line) if at else line
                root = at.get(own, own)
                if root is None or root in seen:
                    gone += 1
                else:
                    seen.add(root)
                    left.append(line)
            total.append(n)
            removed.append(gone)
            kept.append("\n".join(left) if text is not None else None)
        own = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*own, *batch.columns[3:]], names=["doc_id", "n_lines", "n_removed", "kept_text", *batch.schema.names[3:]])


def line_dedup(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text and the ``carried`` columns of ``docs`` for each row: of similar lines the first stays.

    Lines with a word are linked at Jaccard similarity of 0.8 or more of their distinct 5-character
    shingles; of a component the first line by doc_id, then place, stays and the others go, in the same
    document too. Null text stays null, with no lines; an empty table gives an empty one. Rows of one
    doc_id are cleaned alike; lines under a null doc_id are cleaned only within their row and are no
    source for others. Very long lines are compared whole. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", *carried)
    known = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    places = cut(known.mapInArrow(_places, "line long, doc_id long"))
    firsts = cut(places.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    release(spark)
    repeated = repeats(docs.filter("doc_id IS NOT NULL"), "doc_id")

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = firsts.join(ids.withColumnRenamed("id", "line"), "line").groupBy(F.col("first").alias("doc_id")).agg(F.collect_set("line").alias("wanted"))
        found = known.join(wanted, "doc_id").select("text", "wanted").mapInArrow(_bodies, "id long, n long, odd array<long>, body string")
        return found.dropDuplicates(["id"]) if repeated else found

    packed = known.select("text").mapInArrow(_packed(parts(spark)), PACKED)
    linked = link(packed, fetch, sifts=[(BITS // 64, most_bits(BITS, PERCENT))], percent=PERCENT, prepare=Shingles, similar=alike)
    grouped = linked.withColumnRenamed("id", "line").join(firsts, "line")
    owners = grouped.groupBy("component").agg(F.min("first").alias("owner"))
    grouped = cut(grouped.join(owners, "component").select("line", "component", "owner"))
    # A line goes from a document if its component (or the line alone) is first met in an earlier one.
    alone = firsts.filter("last > first").join(grouped, "line", "left_anti").select("line", F.col("first").alias("owner"), F.lit(None).cast("long").alias("component"))
    moved = grouped.select("line", "owner", "component").unionByName(alone)
    hits = places.join(moved, "line").filter("doc_id > owner OR component IS NOT NULL")
    found = hits.groupBy("doc_id").agg(F.collect_set(F.struct("line", F.when(F.col("doc_id") == F.col("owner"), F.col("component")).alias("root"))).alias("found"))
    found = cut(found)
    release(spark)
    out = docs.join(found, "doc_id", "left").select("doc_id", "text", "found", *carried)
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return out.mapInArrow(_strip, f"doc_id long, n_lines long, n_removed long, kept_text string{more}")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
