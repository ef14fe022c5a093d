"""From banded sketches to connected components, without all pairs of a group.

1. Sketching tasks send their band values as packed blocks of (band, id); a task sorts its share in
   numpy and keeps the bands that several ids share. A band that is crowded within one sketching task
   is sent once by it: its other ids are bound to that one there and then, so no task ever gathers a
   great group.
2. Every member is tried against the least id of each of its buckets. Links make components. That is
   all there is to a bucket of two; of the larger ones, those of several components are open.
3. While trying all that is left there would cost much more than the rows it has, members outside
   their bucket's main component (that of a random member, so most often the largest) are tried
   against random members of such.
4. What is left in open buckets, members outside the main component against all of another one, is
   joined; set sizes and sketches are part of the join condition, so a dissimilar pair is no row.
   While these are more than the rows there, one pair for each two components is confirmed at a time,
   as long as that leaves many fewer; then all that lie between components. After that every pair of
   a bucket is linked, in one component, or tried: nothing is capped.

Links are always confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm import _words as W
from groveline.llm._shared import cut, discard, release, scratch

#: Most differing sketch bits, or a function of both sizes n that gives them.
Limit = int | Callable[[Column, Column], Column]
#: For each bitmap of a sketch, one after another: its longs, and its limit.
Sifts = list[tuple[int, Limit]]
#: Band values that a sketching task holds before it sends them; a band is crowded if it is met more than CROWDED times in 1 of EVERY of them.
HELD, EVERY, CROWDED = 1 << 20, 11, 8
#: Tries of a member in a round of random tries; joined pairs a row above which a round is worth while, and the share of them that the one before must not have left.
TRIES, WORTH, LESS = 6, 16, 0.6
#: Tries of a member that the sketches let through and that are confirmed in a round; what they leave unlinked stays open.
CONFIRMED = 3
#: Edges that one task contracts; more are parted.
BLOCK = 1 << 20
PACKED = "part int, kind byte, block binary"
#: Kinds of block: (band, id); ids bound to the least one of a crowded band; (band, id) of such least ones, whose bands have others elsewhere.
PLAIN, BOUND, LEAST = 0, 1, 2


def parts(spark: SparkSession) -> int:
    """Blocks that the bands are dealt out to: some for each shuffle partition, so that a task holds one at a time."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


class Packer:
    """Gathers (bands, ids) of a sketching task and gives packed blocks."""

    def __init__(self, n: int):
        self.n, self.bands, self.ids, self.held = n, [], [], 0

    def add(self, bands: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``bands``: a row of values for each of ``ids``."""
        if len(ids):
            self.bands.append(bands.reshape(-1))
            self.ids.append(np.repeat(ids, bands.shape[1]))
            self.held += bands.size
        if self.held >= HELD:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        rows: tuple[list, list, list] = ([], [], [])
        if self.held:
            band, own = np.concatenate(self.bands), np.concatenate(self.ids)
            self.bands, self.ids, self.held = [], [], 0
            values, often = np.unique(band[::EVERY], return_counts=True)
            hot = values[often > CROWDED]
            if len(hot):
                at = np.flatnonzero(np.isin(band, hot))
                at = at[np.lexsort((own[at], band[at]))]
                first = np.ones(len(at), bool)
                first[1:] = band[at[1:]] != band[at[:-1]]
                least = own[at][np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
                bound = np.stack([band[at].view(np.int64), own[at], least])[:, ~first]
                rows[0].append(int(bound[1].sum() % self.n))
                rows[1].append(BOUND)
                rows[2].append(bound.tobytes())
                alone, kinds = np.ones(len(band), bool), np.zeros(len(band), bool)
                alone[at[~first]] = False
                kinds[at[first]] = True
                self._deal(rows, band[kinds], own[kinds], LEAST)
                alone &= ~kinds
                band, own = band[alone], own[alone]
            self._deal(rows, band, own, PLAIN)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int8()), pa.array(rows[2], pa.binary())], names=["part", "kind", "block"])

    def _deal(self, rows: tuple[list, list, list], band: np.ndarray, own: np.ndarray, kind: int) -> None:
        part = (band >> np.uint64(40)) % np.uint64(self.n)
        order = np.argsort(part.astype(np.uint16) if self.n < 65536 else part, kind="stable")
        band, own, edges = band[order], own[order], np.searchsorted(part[order], np.arange(self.n + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[k], edges[k + 1]
            rows[0].append(k)
            rows[1].append(kind)
            rows[2].append(band[a:b].tobytes() + own[a:b].tobytes())


def _shared(blocks: list[np.ndarray], crowded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Band, id, the band's least id and whether these are two and all, for bands with several ids; ``crowded`` bands have more elsewhere."""
    pairs = [b.reshape(2, -1) for b in blocks]
    band, own = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    order = np.argsort(band)
    same = band[order[1:]] == band[order[:-1]]
    several = np.zeros(len(band), bool)
    several[1:] = same
    several[:-1] |= same
    at = order[several]
    band, own = band[at], own[at]
    order = np.lexsort((own, band))
    band, own = band[order], own[order]
    new = np.ones(len(band), bool)
    new[1:] = (band[1:] != band[:-1]) | (own[1:] != own[:-1])
    band, own = band[new], own[new]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(band)), bool), band[1:] != band[:-1]]))
    sizes = np.diff(np.append(starts, len(band)))
    least, two = np.repeat(own[starts], sizes), np.repeat(sizes == 2, sizes)
    if crowded:
        two &= ~np.isin(band, np.concatenate(crowded))
    several = np.repeat(sizes > 1, sizes)
    return band[several], own[several], least[several], two[several]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks sorted by part: rows of the bands that several ids share. One part is held at a time."""
    names, held, crowded, last = ["band", "id", "least", "two"], [], [], None

    def rows(band: np.ndarray, own: np.ndarray, least: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (band, own, least)), pa.array(two, pa.bool_())], names=names)

    for batch in batches:
        for part, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values = np.frombuffer(block, np.int64)
            if kind == BOUND:
                band, own, least = values.reshape(3, -1)
                yield rows(band, own, least, np.zeros(len(band), bool))
                # The one that was sent may meet nobody else, so it is told here as well.
                new = np.ones(len(band), bool)
                new[1:] = band[1:] != band[:-1]
                yield rows(band[new], least[new], least[new], np.zeros(int(new.sum()), bool))
                continue
            if part != last and held:
                yield rows(*_shared(held, crowded))
                held, crowded = [], []
            last = part
            held.append(values)
            if kind == LEAST:
                crowded.append(values[: len(values) // 2])
    if held:
        yield rows(*_shared(held, crowded))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of one task to stars with the same components: each id that isn't the least of its own, and that least."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    u, v = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[other], pa.int64()), pa.array(ids[label[other]], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: edges (a, b) to (id, component = least id).

    Tasks contract blocks of at most about ``BLOCK`` edges to stars. One block is done at once; several
    are brought together by alternating large and small stars.
    """
    pairs = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v"))
    contracted = lambda df, n: cut(df.repartition(n).mapInArrow(_contract, "u long, v long"))
    blocks = 1 + pairs.count() // BLOCK
    pairs, before = contracted(pairs, blocks), None
    while blocks > 1:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        pairs = cut(joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        after = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    return pairs.union(pairs.select("v", "v").distinct()).toDF("id", "component")


def parity(members: np.ndarray, of: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each of ``n`` sets a bitmap, as signed longs, in which every member (hash; number of its set) flips one bit."""
    odd = np.bincount(of * bits + (W.mix(members, 21) % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def most_bits(bits: int, percent: int) -> Limit:
    """Bits in which the parity bitmaps of two sets of that similarity may differ.

    They can't differ in more bits than the sets differ in members, so that bound loses nothing; for
    sets that fill the bitmap, four deviations above the mean at the threshold are fewer.
    """

    def limit(low: Column, high: Column) -> Column:
        most = (low + high) * ((100 - percent) / (100 + percent))
        return F.least(most + 1e-6, bits / 2 * (1 - F.exp(-2 / bits * most)) + 4 * F.sqrt(most))

    return limit


def _alike(a: str, b: str, sifts: Sifts, percent: int) -> Column:
    low, high = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    near, at = low * 100 >= high * percent, 0
    for longs, limit in sifts:
        bits = sum((F.bit_count(F.col(f"{a}odd")[i].bitwiseXOR(F.col(f"{b}odd")[i])) for i in range(at, at + longs)), F.lit(0))
        near, at = near & (bits <= (limit(low, high) if callable(limit) else limit)), at + longs
    return near


def _test(prepare: Callable[[Any], Any], similar: Callable[[Any, Any], bool]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ready = None, None
        for batch in batches:
            good = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:  # rows come sorted by b, which many may share
                    last, ready = b, prepare(y.as_py())
                good.append(similar(prepare(x.as_py()), ready))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return keep


def link(packed: DataFrame, fetch: Callable[[DataFrame], DataFrame], *, sifts: Sifts, percent: int, prepare: Callable[[Any], Any], similar: Callable[[Any, Any], bool]) -> DataFrame:
    """Components of the sketches in ``packed`` (of ``Packer``) as (id, component); ids without a link are left out.

    ``fetch`` turns ids into (id, n = size of the set, odd array<long>, body). ``prepare`` turns a body
    into what ``similar`` compares.
    """
    spark = packed.sparkSession
    at = {k: scratch(spark) for k in ("rows", "bodies")}
    blocks = packed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")
    rows = cut(blocks.mapInArrow(_buckets, "band long, id long, least long, two boolean"), path=at["rows"])
    release(spark)
    bodies = cut(fetch(rows.select("id").distinct()), path=at["bodies"])
    release(spark)
    sketches = bodies.select("id", "n", "odd")
    side = lambda df, c: df.select(F.col("id").alias(c), *(F.col(k).alias(f"{c}{k}") for k in df.columns[1:]))
    near = _alike("a", "b", sifts, percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of (a, b), b perhaps in many, that are similar."""
        y = side(bodies, "y")
        whole = pairs.join(side(bodies, "a"), "a").join(y, (pairs["b"] == y["y"]) & _alike("a", "y", sifts, percent))
        out = cut(whole.select("a", "b", "abody", "ybody").mapInArrow(_test(prepare, similar), "a long, b long"))
        release(spark)
        return out

    def sifted(pairs: DataFrame) -> DataFrame:
        return cut(pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").filter(near).select("a", "b"))

    known = components(confirmed(sifted(rows.filter("least < id").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct())))
    merged = lambda edges: components(edges.union(known.select("id", "component")))
    rows = rows.filter("NOT two").select("band", "id")
    turn, before, last = 0, float("inf"), None
    while True:
        path = scratch(spark)
        open_, cost, size = _open(rows, known, turn, path)
        if last:
            discard(spark, last)
        if cost <= WORTH * size or cost > LESS * before:
            break
        turn, before = turn + 1, cost
        tries = open_.filter("c <> main").groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("rep", F.lit(turn)).alias("k"), "rep"))), 1, TRIES).alias("reps"))
        tries = tries.select(F.col("id").alias("a"), F.explode("reps").alias("r")).select("a", F.col("r.rep").alias("b"))
        hopeful = sifted(tries).groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("b", F.lit(turn)).alias("k"), "b"))), 1, CONFIRMED).alias("bs"))
        known = merged(confirmed(cut(hopeful.select("a", F.explode("bs").alias("r")).select("a", F.col("r.b").alias("b")))))
        # Components only grow: a bucket of one stays closed.
        rows, last = open_.select("band", "id"), path
        release(spark)
    # A pair that shares several open buckets is a row in the first of them only.
    own = open_.groupBy("id").agg(F.first("c").alias("c"), F.collect_set(F.struct("band", "main")).alias("at"))
    full = own.join(sketches, "id").select("id", "n", "odd", "c", F.col("at.band").alias("bands"), F.explode("at").alias("o")).select("id", "n", "odd", "c", "bands", "o.band", "o.main")
    kept = ("id", "n", "odd", "c", "bands")
    x = full.filter("c <> main").select("band", *(F.col(k).alias(f"x{k}") for k in kept))
    y = full.select("band", *(F.col(k).alias(f"y{k}") for k in kept), (F.col("c") == F.col("main")).alias("ymain"))
    fresh = (F.col("xc") != F.col("yc")) & (F.col("ymain") | (F.col("xid") < F.col("yid")))
    once = x["band"] == F.array_min(F.array_intersect("xbands", "ybands"))
    rest = x.join(y, (x["band"] == y["band"]) & fresh & _alike("x", "y", sifts, percent) & once)
    rest = cut(rest.select(F.col("xid").alias("a"), F.col("yid").alias("b"), F.least("xc", "yc").alias("low"), F.greatest("xc", "yc").alias("high"))) if size else None
    discard(spark, path)
    discard(spark, at["rows"])
    left = rest.count() if size else 0
    while left > size:
        # One pair for each two components first: what those links connect needs no other.
        first = cut(rest.groupBy("low", "high").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"))
        known = merged(confirmed(first))
        own = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"{c}c"))
        other = rest.join(first, ["a", "b"], "left_anti").select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left")
        other = other.select("a", "b", F.coalesce("ac", "a").alias("ac"), F.coalesce("bc", "b").alias("bc")).filter("ac <> bc")
        rest, before = cut(other.select("a", "b", F.least("ac", "bc").alias("low"), F.greatest("ac", "bc").alias("high"))), left
        left = rest.count()
        release(spark)
        if left > LESS * before:
            break
    if left:
        known = merged(confirmed(rest.select("a", "b")))
    discard(spark, at["bodies"])
    return known


def _open(rows: DataFrame, known: DataFrame, turn: int, path: str) -> tuple[DataFrame, int, int]:
    """Members (band, id, c) of the buckets with several components, a random member ``rep`` of each bucket and its component ``main``,
    so most often the largest one; written at ``path``. Also the pairs that joining them all could make, and how many members."""
    spark = rows.sparkSession
    # Read twice below, so written: the join is made once.
    held = scratch(spark)
    own = cut(rows.join(known, "id", "left").select("band", "id", F.coalesce("component", "id").alias("c")), path=held)
    pick = F.min(F.struct(F.xxhash64("id", "band", F.lit(turn)).alias("h"), F.col("id").alias("rep"), F.col("c").alias("main")))
    mixed = own.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("all"), pick.alias("pick")).filter("low < high")
    out = cut(own.join(mixed.select("band", "all", "pick.rep", "pick.main"), "band"), path=path)
    discard(spark, held)
    size, cost = out.agg(F.count(F.lit(1)), F.sum(F.when(F.col("c") != F.col("main"), F.col("all").cast("double")).otherwise(0.0))).first()
    return out, int(cost or 0), size
