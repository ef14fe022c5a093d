"""Near-duplicate documents: MinHash bands give candidates, odd sketches sift them, full sets decide.

A document's MinHash samples are folded into a parity bitmap: each sample flips one bit. The bits in
which two bitmaps differ estimate how many samples differ, J ~ 1 + n/(4k) * ln(1 - 2z/n) for n bits,
k samples and z differing bits; that is sharp where the similarity is high. A second bitmap, of all
members, bounds their difference from below and so spares texts that samples leave in doubt.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm import _words as W
from groveline.llm._links import PACKED, Packer, components, link, most_bits, parity, parts
from groveline.llm._shared import cut, flat, read_table, repeats, slices

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, BITS = 28, 4, 1024
SAMPLES = BANDS * ROWS
#: Sketches may differ in as many bits as at an estimated similarity of SIFT, some four deviations below the threshold.
SIFT = 0.55
#: Bits of the parity bitmap of the whole set, which rules out what the samples leave in doubt.
WHOLE = 2048
LIMIT = math.ceil(BITS / 2 * (1 - math.exp((SIFT - 1) * 4 * SAMPLES / BITS)))


def _shingles(column: pa.Array):
    """Distinct shingle hashes ordered by document: hashes, and the bounds of each document's; word hashes with theirs."""
    data, offsets = flat(column)
    data = W.LOWER[data]
    starts, ends, docs = W.spans(data, offsets)
    words = W.word_hashes(data, starts, ends)
    edges = np.searchsorted(docs, np.arange(len(offsets)))
    at = np.flatnonzero(W.inside(docs, SHINGLE))
    hashes, of = (W.grams(words, SHINGLE)[at], docs[at]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    short = np.flatnonzero((np.diff(edges) > 0) & (np.diff(edges) < SHINGLE))
    if len(short):
        whole = np.concatenate([W.grams(words[edges[d] : edges[d + 1]], int(edges[d + 1] - edges[d])) for d in short])
        hashes, of = np.concatenate([hashes, whole]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    bounds = np.searchsorted(of, np.arange(len(offsets))).tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        hashes[a:b].sort()
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(len(offsets))), words, edges


def _signed(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.view(np.int64).reshape(-1)), rows.shape[1]).cast(pa.list_(pa.int64()))


def _minima(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of each MinHash sample, its values, and the documents that have any."""
    some = np.flatnonzero(np.diff(bounds))
    for k in range(SAMPLES) if len(some) else ():
        low = np.minimum.reduceat((hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k), bounds[:-1][some])
        yield k, W.mix(low, 100 + k), some


def _digests(words: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Of the word sequences, by 128 bits."""
    return [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, bounds, words, edges = _shingles(batch.column(1))
        acc = np.zeros((BANDS, batch.num_rows), np.uint64)
        for k, own, some in _minima(hashes, bounds):
            acc[k // ROWS, some] = W.mix(acc[k // ROWS, some] ^ own, 7)
        bands = W.mix(acc.T ^ np.arange(BANDS, dtype=np.uint64), 11)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(_digests(words, edges), pa.binary()), _signed(bands)], names=["doc_id", "n", "digest", "bands"])


def _packed(parts: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            bands = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            yield from packer.add(bands.reshape(-1, BANDS), batch.column(0).to_numpy(zero_copy_only=False))
        yield packer.flush()

    return pack


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, bitmaps of the whole set and of the samples, and text; columns doc_id, text."""
    for batch in slices(batches, "text"):
        hashes, bounds, _, _ = _shingles(batch.column(1))
        odd = np.zeros((batch.num_rows, BITS // 64), np.uint64)
        for _, own, some in _minima(hashes, bounds):
            bit = own % np.uint64(BITS)
            odd[some, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
        whole = parity(hashes, np.repeat(np.arange(batch.num_rows), np.diff(bounds)), batch.num_rows, WHOLE)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), _signed(np.concatenate([whole, odd.view(np.int64)], axis=1)), batch.column(1)], names=["id", "n", "odd", "body"])


def _set(text: str) -> np.ndarray:
    return _shingles(pa.array([text], pa.large_string()))[0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two full sets, sorted hashes of distinct shingles, is high enough."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def minhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Documents are linked if 100 * |A & B| >= 75 * |A | B| of their distinct 5-word shingles (A-Z lowered;
    a shorter text is one shingle). Null, empty and blank texts have none and link with nothing.
    Rows of one ``doc_id`` count as one node: a link of any is a link of all, and all are kept or none.
    A null ``doc_id`` is linked with nothing, has a null component and is kept. An empty table gives an
    empty one; texts of any length are compared whole; other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    every = cut(docs.mapInArrow(_sketches, "doc_id long, n long, digest binary, bands array<long>"))
    known = every.filter("doc_id IS NOT NULL AND n > 0")
    classes = cut(known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    same = known.select("digest", "doc_id").join(classes.filter("copies > 1").drop("copies"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).filter("a <> b")
    # Documents whose words another one of smaller id has are not compared: they hang on that one.
    heads = known.join(classes.select("digest", F.col("id").alias("doc_id")), ["digest", "doc_id"], "left_semi").select("doc_id", "bands")
    repeated = repeats(known, "doc_id")

    def fetch(ids: DataFrame) -> DataFrame:
        texts = docs.filter("text IS NOT NULL").join(ids.withColumnRenamed("id", "doc_id"), "doc_id")
        texts = texts.dropDuplicates() if repeated else texts
        return texts.select("doc_id", "text").mapInArrow(_bodies, "id long, n long, odd array<long>, body string")

    linked = link(heads.mapInArrow(_packed(parts(spark)), PACKED), fetch, sifts=[(WHOLE // 64, most_bits(WHOLE, PERCENT)), (BITS // 64, LIMIT)], percent=PERCENT, prepare=_set, similar=similar)
    near = linked.select(F.col("id").alias("a"), F.col("component").alias("b"))
    # Copies hang on their class's least id, and so do the links between classes: stars over stars.
    tops = components(near.union(same)).select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))
    out = every.select("doc_id", "n").join(tops, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(read_table(spark, sf_dir, "documents"))


SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+{SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id"""
