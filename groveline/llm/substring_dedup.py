"""Exact substring deduplication over a log-structured fingerprint index.

Windows of 13 words are fingerprinted with 128 bits, of which the second half verifies the first: it is
made of another, unrelated hash of every word. History is a list of sorted immutable runs, bucketed by
fingerprint. A new batch, whose documents all come later, is merge-joined with each run, which stays
where it is; what was new becomes a run, and when more than ``fanout`` runs exist they are compacted into one.

To keep the index small a corpus pass goes first: every window is assigned the least 4-word
fingerprint in it (equal windows get equal anchors), and only windows whose anchor occurs under
two document ids can repeat, so only those are indexed. That filter is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm import _words as W
from groveline.llm._shared import children, complete, cut, discard, flat, read_table, release, scratch, slices

WINDOW, GRAM = 13, 4


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _windows(column: pa.Array):
    """Word spans and two unrelated hashes of each word, and for each window that lies in one document: place of its first word, anchor."""
    data, offsets = flat(column)
    starts, ends, docs = W.spans(data, offsets)
    words = W.word_hashes(data, starts, ends)
    at = np.flatnonzero(W.inside(docs, WINDOW))
    anchor = W.sliding_min(W.grams(words, GRAM), WINDOW - GRAM + 1)[at] if len(at) else np.zeros(0, np.uint64)
    return data, starts, ends, docs, words, at, anchor


def _fingerprint(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits of the windows at ``at``: two hashes over unrelated hashes of the words."""
    other = W.word_hashes(data, starts, ends, 2)
    return _signed(W.grams(words, WINDOW, 5)[at]), _signed(W.grams(other, WINDOW, 9)[at])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        *_, docs, _, at, anchor = _windows(batch.column(1))
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (docs[at[1:]] != docs[at[:-1]])
        ids = batch.column(0).to_numpy(zero_copy_only=False)[docs[at[new]]]
        yield pa.RecordBatch.from_arrays([pa.array(_signed(anchor[new])), pa.array(ids.astype(np.int64))], names=["anchor", "doc_id"])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows (low, high, doc_id) of columns doc_id, text and perhaps anchors, of which a window must have one."""
    for batch in slices(batches, "text"):
        data, starts, ends, docs, words, at, anchor = _windows(batch.column(1))
        if not len(at):
            continue
        of = docs[at]
        if batch.num_columns > 2:
            shared, bounds = batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.column(2).offsets.to_numpy()
            bounds = bounds - bounds[0]
            hit = np.zeros(len(at), bool)
            edges = np.searchsorted(of, np.arange(batch.num_rows + 1))
            for d in range(batch.num_rows):
                a, b = edges[d], edges[d + 1]
                if b > a:
                    hit[a:b] = np.isin(_signed(anchor[a:b]), shared[bounds[d] : bounds[d + 1]])
            at, of = at[hit], of[hit]
        ids = batch.column(0).to_numpy(zero_copy_only=False)[of]
        low, high = _fingerprint(data, starts, ends, words, at)
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(ids.astype(np.int64))], names=["low", "high", "doc_id"])


def _among(low: np.ndarray, high: np.ndarray, gone: pa.Array) -> np.ndarray:
    """Which of the fingerprints are in ``gone`` (structs)."""
    a, b = (gone.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    order = np.argsort(a)
    a, b = a[order], b[order]
    if (a[1:] == a[:-1]).any():  # equal in one half only: compare whole ones
        known = set(zip(a.tolist(), b.tolist(), strict=True))
        return np.array([x in known for x in zip(low.tolist(), high.tolist(), strict=True)], bool)
    at = np.minimum(np.searchsorted(a, low), len(a) - 1)
    return (a[at] == low) & (b[at] == high)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, starts, ends, docs, words, at, _ = _windows(batch.column(1))
        low, high = _fingerprint(data, starts, ends, words, at) if len(at) else (np.zeros(0, np.int64),) * 2
        gone, whole = batch.column(2), pc.fill_null(batch.column(3), False).to_pylist()
        raw = data.tobytes()
        word_edges = np.searchsorted(docs, np.arange(batch.num_rows + 1))
        window_edges = np.searchsorted(docs[at], np.arange(batch.num_rows + 1)) if len(at) else np.zeros(batch.num_rows + 1, int)
        n_words, n_removed, kept = [], [], []
        for d in range(batch.num_rows):
            a, b = word_edges[d], word_edges[d + 1]
            keep = np.ones(b - a, bool)
            if whole[d] and b - a >= WINDOW:
                keep[:] = False
            elif gone[d].is_valid and len(gone[d]) and b - a >= WINDOW:
                u, v = window_edges[d], window_edges[d + 1]
                hit = at[u:v][_among(low[u:v], high[u:v], gone[d].values)] - a
                step = np.zeros(b - a + 1, np.int64)
                np.add.at(step, hit, 1)
                np.add.at(step, hit + WINDOW, -1)
                keep = np.cumsum(step)[:-1] == 0
            n_words.append(b - a)
            n_removed.append(int((~keep).sum()))
            kept.append(b" ".join(raw[s:e] for s, e in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist(), strict=True)).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.large_string() if sum(map(len, kept)) >> 30 else pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints below one folder; what runs there are is read off the folder.

    A run is a table bucketed by fingerprint and sorted, so merging a batch with it moves the batch
    only. A later session that opens the folder goes on from its runs; ``buckets`` must be the same.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, root: str | None = None, buckets: int | None = None):
        self.spark, self.fanout, self.root = spark, fanout, root or scratch(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}
        for path in children(spark, self.root):
            if path.rsplit("/", 1)[-1].startswith("run-") and complete(spark, path):
                self._open(path)
        self.written = max((int(p.rsplit("-", 1)[-1]) for p in self.tables), default=0)

    def _open(self, path: str) -> None:
        name = f"fingerprints_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (low BIGINT, high BIGINT) USING parquet CLUSTERED BY (low, high) SORTED BY (low, high) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self.tables[path] = name

    def _write(self, keys: DataFrame) -> None:
        self.written += 1
        path, name = f"{self.root}/run-{self.written:05d}", f"fingerprints_{uuid.uuid4().hex}"
        keys = keys.select("low", "high").repartition(self.buckets, "low", "high")
        keys.write.bucketBy(self.buckets, "low", "high").sortBy("low", "high").option("path", path).saveAsTable(name)
        self.tables[path] = name

    def add(self, windows: DataFrame, absorb: bool = True) -> DataFrame:
        """Merge-join a batch (low, high, doc_id; later than all before it) and absorb it; returns (doc_id, low, high) of its repeats.

        ``absorb`` may be false for a batch after which nothing comes: its run would never be read.
        """
        seen = windows.groupBy("low", "high").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        known = F.lit(False)
        for k, name in enumerate(self.tables.values()):
            seen = seen.join(self.spark.table(name).withColumn(f"in{k}", F.lit(True)), ["low", "high"], "left")
            known = known | F.coalesce(f"in{k}", F.lit(False))
        path = scratch(self.spark)
        keys = cut(seen.select("low", "high", "first", "last", known.alias("seen")), path=path)
        if absorb:
            self._write(keys.filter(~F.col("seen")))
        release(self.spark)
        if len(self.tables) > self.fanout:
            self.compact()
        repeated = keys.filter(F.col("seen") | (F.col("first") < F.col("last"))).drop("last")
        hits = windows.join(repeated, ["low", "high"]).filter(F.col("seen") | (F.col("doc_id") > F.col("first")))
        out = cut(hits.select("doc_id", "low", "high").distinct())
        discard(self.spark, path)
        return out

    def compact(self) -> None:
        """Bring all runs into one; runs never share a fingerprint, unless a compaction broke off before it deleted them."""
        old = dict(self.tables)
        self._write(reduce(DataFrame.union, map(self.spark.table, old.values())).distinct())
        for path, name in old.items():
            self.spark.sql(f"DROP TABLE {name}")
            discard(self.spark, path)
            del self.tables[path]

    def close(self, delete: bool) -> None:
        for path, name in self.tables.items():
            self.spark.sql(f"DROP TABLE {name}")
            if delete:
                discard(self.spark, path)
        self.tables = {}


def substring_dedup(docs: DataFrame, batches: int = 3, fanout: int = 2, root: str | None = None) -> DataFrame:
    """Remove each word covered by a 13-word window that also starts under a smaller ``doc_id``.

    Takes ``doc_id`` and ``text``; returns doc_id, n_words, n_removed, kept_text, a row for each row.
    Null or empty text: no words. Null ``doc_id``: neither a source nor judged, all words stay.
    Rows that repeat a ``doc_id`` count as one id, so they never remove each other's words. Texts of
    any length are read whole; an empty table gives an empty one; other columns are not looked at.

    ``root``: the folder of an index that lasts. What it holds counts as earlier than ``docs``, and
    all windows of ``docs`` are added to it (without one, only those that can repeat are indexed).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    # Whole copies of earlier texts lose every window at once and bring nothing new: they stay out of the index.
    texts = known.select("doc_id", F.sha2("text", 256).alias("digest"))
    owners = texts.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = cut(texts.join(owners, "digest", "left").groupBy("doc_id").agg(F.min(F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False))).alias("copy")).filter("copy"))
    if root is None:
        anchors = known.mapInArrow(_anchors, "anchor long, doc_id long")
        shared = cut(anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor"))
        release(spark)
        flagged = anchors.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")).join(copies, "doc_id", "left_anti")
        indexed = known.join(flagged, "doc_id")
    else:
        indexed = known.join(copies, "doc_id", "left_anti")
    edges = known.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    batch = sum((F.when(F.col("doc_id") > e, 1).otherwise(0) for e in edges), F.lit(0))
    path = scratch(spark)
    windows = cut(indexed.mapInArrow(_fingerprints, "low long, high long, doc_id long").withColumn("batch", batch), partition_by=("batch",), path=path)
    release(spark)
    index, hits = FingerprintIndex(spark, fanout, root), None
    rounds = len(set(edges)) + 1
    for b in range(rounds):
        found = index.add(windows.filter(F.col("batch").isin(_levels(edges, b))).drop("batch"), root is not None or b + 1 < rounds)
        hits = found if hits is None else hits.unionByName(found)
        for v in _levels(edges, b):
            discard(spark, f"{path}/batch={v}")
        release(spark)
    index.close(delete=root is None)
    gone = hits.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("gone"))
    gone = gone.join(copies, "doc_id", "full")
    return docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone", "copy").mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_text string")


def _levels(edges: list[int], b: int) -> list[int]:
    """Values of the batch number in the ``b``-th non-empty range (equal edges skip numbers)."""
    distinct = sorted(set(edges))
    return [sum(1 for e in edges if e < distinct[b])] if b < len(distinct) else [len(edges)]


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
keyed AS (SELECT rid, doc_id, p, array_to_string(w[p:p+12], ' ') AS k FROM win),
least AS (SELECT k, min(doc_id) AS m FROM keyed GROUP BY k),
hit AS (SELECT DISTINCT rid, p + o AS pos FROM (SELECT rid, p FROM keyed JOIN least USING (k) WHERE doc_id > m), (SELECT unnest(range(0, 13)) AS o)),
gone AS (SELECT rid, list(pos) AS l, count(*) AS n FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(l, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)"""
