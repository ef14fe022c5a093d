"""Connected components; ids are of any type that can be ordered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.session import cut

#: Edges that one task contracts; more are parted.
BLOCK = 1 << 18


def _key(v):
    return tuple(v.values()) if isinstance(v, dict) else v


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of one task to stars with the same components, on their least id."""
    top, value, schema = {}, {}, None

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for batch in batches:
        schema = batch.schema
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = _key(u), _key(v)
            for k, x in ((a, u), (b, v)):
                if k not in top:
                    top[k], value[k] = k, x
            a, b = sorted((find(a), find(b)))
            top[b] = a
    if schema is not None:
        pairs = [(value[k], value[find(k)]) for k in top if find(k) != k]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.field(i).type) for i in (0, 1)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (id, component): component is the least id that is reachable. Ids without an edge are left out.

    Tasks contract blocks of about ``BLOCK`` edges to stars. One block is done at once; several are
    brought together by alternating large and small stars.
    """
    pairs = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v"))
    blocks, before = 1 + pairs.count() // BLOCK, None
    pairs = cut(pairs.repartition(blocks).mapInArrow(_contract, pairs.schema))
    while blocks > 1:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("n"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "n").alias("v")).distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = cut(joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        after = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    return pairs.union(pairs.select("v", "v").distinct()).toDF("id", "component")
