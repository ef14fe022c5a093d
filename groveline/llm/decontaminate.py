"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (a run of ``SEED`` tokens) are compared: the longest
matches of unmarked tokens are found by running Karp-Rabin, marked in both without overlap, and the
search goes on with shorter ones. The share of an item's tokens that get marked doesn't depend on the
order of its passages in the document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm import _words as W
from groveline.llm._shared import cut, flat, read_table, slices

SEED = 4
#: A document is contaminated by an item of which so many percent of the tokens are tiled.
COVERED = 50
#: Bytes of item text that are matched in one pass; larger benchmarks take several passes over the documents.
BLOCK_BYTES = 8 << 20
_BASE, _MOD = 0x5851F42D, (1 << 61) - 1
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 0x20


def tokens(column: pa.Array):
    """Lowered words without ASCII punctuation: hashes, document of each."""
    data, offsets = flat(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    data = _PLAIN[data]
    starts, ends, docs = W.spans(data, offsets)
    return W.word_hashes(data, starts, ends), docs


def _rolling(values: list[int], free: list[bool], n: int) -> Iterator[tuple[int, int]]:
    """Place and hash of each window of ``n`` unmarked values."""
    top, h, run = pow(_BASE, n, _MOD), 0, 0
    for i, v in enumerate(values):
        if not free[i]:
            h = run = 0
            continue
        h = (h * _BASE + v) % _MOD
        run += 1
        if run > n:
            h = (h - values[i - n] * top) % _MOD
        if run >= n:
            yield i - n + 1, h


def _longest_run(free: list[bool]) -> int:
    best = run = 0
    for x in free:
        run = run + 1 if x else 0
        best = max(best, run)
    return best


def tile(pattern: list[int], text: list[int | None], least: int = SEED) -> int:
    """Tokens of ``pattern`` marked by greedy tiling with ``text`` (None parts it)."""
    p_free, t_free = [True] * len(pattern), [v is not None for v in text]
    solid = [v or 0 for v in text]
    n = min(_longest_run(p_free), _longest_run(t_free))
    while n >= least:
        where = defaultdict(list)
        for j, h in _rolling(solid, t_free, n):
            where[h].append(j)
        for i, h in list(_rolling(pattern, p_free, n)):
            for j in where.get(h, ()):
                if all(p_free[i : i + n]) and all(t_free[j : j + n]) and pattern[i : i + n] == solid[j : j + n]:
                    p_free[i : i + n] = t_free[j : j + n] = [False] * n
                    break
        n = min(n - 1, _longest_run(p_free), _longest_run(t_free))
    return p_free.count(False)


class Items:
    """Tokens of a block of benchmark items, and where each seed occurs."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        hashes, docs = tokens(pa.array([t for _, t in rows], pa.large_string()))
        bounds = np.searchsorted(docs, np.arange(len(rows) + 1))
        self.words = [(hashes[a:b] >> np.uint64(4)).tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
        at = np.flatnonzero(W.inside(docs, SEED))
        seeds = W.grams(hashes, SEED)[at] if len(at) else np.zeros(0, np.uint64)
        self.of: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, d, p in zip(seeds.tolist(), docs[at].tolist(), (at - bounds[docs[at]]).tolist(), strict=True):
            self.of[s].append((d, p))
        self.seeds = np.unique(seeds)

    def found(self, words: list[int], at: list[int], seeds: list[int], percent: int) -> list[tuple[int, int, int]]:
        """(item number, tokens covered, tokens) of the items that the document with these seed hits contains."""
        spots: dict[int, tuple[set, set]] = defaultdict(lambda: (set(), set()))
        for p, s in zip(at, seeds, strict=True):
            for item, q in self.of[s]:
                spots[item][0].add(p)
                spots[item][1].add(q)
        out = []
        for item in sorted(spots):
            here, there = spots[item]
            size = len(self.words[item])
            if 100 * len({q + k for q in there for k in range(SEED)}) < percent * size:
                continue
            text, last = [], None
            for p in sorted({p + k for p in here for k in range(SEED)}):
                if last is not None and p != last + 1:
                    text.append(None)
                text.append(words[p])
                last = p
            covered = tile(self.words[item], text)
            if 100 * covered >= percent * size:
                out.append((item, covered, size))
        return out


def _matcher(items: Items, percent: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, docs = tokens(batch.column(1))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            at = np.flatnonzero(W.inside(docs, SEED))
            if len(at) and len(items.seeds):
                seeds = W.grams(hashes, SEED)[at]
                place = np.minimum(np.searchsorted(items.seeds, seeds), len(items.seeds) - 1)
                hit = items.seeds[place] == seeds
                at, seeds = at[hit], seeds[hit]
                bounds = np.searchsorted(docs, np.arange(batch.num_rows + 1))
                for d in np.unique(docs[at]).tolist():
                    own = docs[at] == d if len(at) < 1000 else slice(*np.searchsorted(docs[at], [d, d + 1]))
                    words = (hashes[bounds[d] : bounds[d + 1]] >> np.uint64(4)).tolist()
                    got = items.found(words, (at[own] - bounds[d]).tolist(), seeds[own].tolist(), percent)
                    found[d] = [{"item_id": items.ids[i], "covered": c, "size": n} for i, c, n in got]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("covered", pa.int64()), ("size", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["row", "items"])

    return match


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    yield rows


def find_contamination(docs: DataFrame, benchmark: DataFrame, percent: int = COVERED, key: str = "doc_id") -> DataFrame:
    """``key`` and ``items`` (array<struct<item_id, covered, size>>, by item_id) for each row of ``docs``.

    Null or empty text contains nothing. Items of fewer than four tokens, or null, are contained in
    nothing. Repeated documents and items are each judged for themselves, whatever their keys. Blocks
    of the benchmark are bounded in bytes and go through all documents one after another; with several,
    rows are numbered and stored first.
    """
    kind, items = docs.schema[key].dataType.simpleString(), "array<struct<item_id: long, covered: long, size: long>>"
    docs = docs.select(F.col(key).alias("row"), "text")
    matchers = [_matcher(Items(rows), percent) for rows in _blocks(benchmark)]
    if len(matchers) == 1:
        return docs.mapInArrow(matchers[0], f"row {kind}, items {items}").withColumnRenamed("row", key)
    rows = cut(docs.withColumn("id", F.monotonically_increasing_id()))
    parts = [rows.select("id", "text").mapInArrow(m, f"row long, items {items}").filter(F.size("items") > 0).withColumn("block", F.lit(k)) for k, m in enumerate(matchers)]
    found = reduce(DataFrame.unionByName, parts).groupBy(F.col("row").alias("id")).agg(F.array_sort(F.collect_list(F.struct("block", "items"))).alias("found"))
    out = rows.select("id", "row").join(found, "id", "left")
    return out.select(F.col("row").alias(key), F.coalesce(F.flatten("found.items"), F.array().cast(items)).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = COVERED) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no benchmark item."""
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("all"), "text")
    packed = whole.withColumn("text", F.coalesce("text", F.lit("")))
    return find_contamination(packed, benchmark, percent, "all").filter(F.size("items") == 0).select("all.*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    best = F.when(F.size("items") > 0, F.get(F.array_sort(F.transform("items", lambda x: F.struct((-x.covered / x["size"]).alias("k"), x.item_id.alias("i"), x.covered.alias("c"), x["size"].alias("n")))), F.lit(0)))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), best["i"].alias("best_item"), best["c"].alias("best_covered"), best["n"].alias("best_tokens"))
