"""Detections against field records: candidates by a bucketed range join, components, pairs, summary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.operators.graph import components


def range_join(a: DataFrame, b: DataFrame, tolerance: float, keys: tuple[str, ...] = ("plot_id",)) -> DataFrame:
    """Pairs within ``tolerance`` (inclusive) of points (keys, a_id, ax, ay) and (keys, b_id, bx, by): an equi-join on square buckets."""
    if not 0 < tolerance < float("inf"):
        raise ValueError("tolerance must be positive and finite")
    cell = lambda c: F.floor(F.col(c) / tolerance)
    spread = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = a.withColumn("_s", spread).withColumn("_i", cell("ax") + F.col("_s.i")).withColumn("_j", cell("ay") + F.col("_s.j")).drop("_s")
    right = b.withColumn("_i", cell("bx")).withColumn("_j", cell("by"))
    out = left.join(right, [*keys, "_i", "_j"]).withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    return out.filter(F.col("distance") <= tolerance).drop("_i", "_j")


def _node(keys: tuple[str, ...], kind: str, id_: str) -> Column:
    """A text that names a crown ('c') or stem ('s') and, as ids are unique in a plot only, its plot."""
    return F.to_json(F.struct(F.lit(kind).alias("kind"), *keys, F.col(id_).cast("string").alias("id")))


def match_components(pairs: DataFrame, keys: tuple[str, ...] = ("plot_id",)) -> DataFrame:
    """The component of each crown and stem in the candidate graph, (id, component); ids are the texts of ``_node``."""
    return components(pairs.select(_node(keys, "c", "a_id").alias("a"), _node(keys, "s", "b_id").alias("b")))


def _assign(n: int, m: int, cost: list[list[int | None]]) -> list[int]:
    """Least-cost assignment of as many rows as possible; whole-number costs of any size (shortest augmenting paths)."""
    big = 1 + sum(c for row in cost for c in row if c is not None)
    size = max(n, m)
    a = [[cost[i][j] if i < n and j < m and cost[i][j] is not None else big for j in range(size)] for i in range(size)]
    u, v, way, p = [0] * (size + 1), [0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        p[0], j0 = i, 0
        low, used = [None] * (size + 1), [False] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], None, 0
            for j in range(1, size + 1):
                if not used[j]:
                    c = a[i0 - 1][j - 1] - u[i0] - v[j]
                    if low[j] is None or c < low[j]:
                        low[j], way[j] = c, j0
                    if delta is None or low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(size + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                elif low[j] is not None:
                    low[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, size + 1):
        i = p[j] - 1
        if i < n and j - 1 < m and cost[i][j - 1] is not None:
            out[i] = j - 1
    return out


def _pair(pdf: pd.DataFrame) -> pd.DataFrame:
    """Most pairs first, then the closest pair as close as can be, then the next: costs are powers of a base above the count."""
    crowns, stems = sorted(set(pdf.a_id.astype(str))), sorted(set(pdf.b_id.astype(str)))
    levels = sorted(set(pdf.distance))
    base = min(len(crowns), len(stems)) + 1
    weight = {d: base ** (len(levels) - 1) * base - base ** (len(levels) - 1 - k) for k, d in enumerate(levels)}
    cost: list[list[int | None]] = [[None] * len(stems) for _ in crowns]
    at = {}
    for r in pdf.itertuples():
        i, j = crowns.index(str(r.a_id)), stems.index(str(r.b_id))
        if cost[i][j] is None or weight[r.distance] < cost[i][j]:
            cost[i][j], at[i, j] = weight[r.distance], r.Index
    rows = [at[i, j] for i, j in enumerate(_assign(len(crowns), len(stems), cost)) if j >= 0]
    return pdf.loc[rows]


def match_pairs(pairs: DataFrame, keys: tuple[str, ...] = ("plot_id",)) -> DataFrame:
    """One-to-one pairs, solved in each component of the candidate graph (components are small: stems within reach)."""
    comp = match_components(pairs, keys).withColumnRenamed("id", "_node")
    labelled = pairs.withColumn("_node", _node(keys, "c", "a_id")).join(comp, "_node").drop("_node")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pair(pdf.sort_values(["a_id", "b_id", "distance"]).reset_index(drop=True))

    return labelled.groupBy("component").applyInPandas(solve, labelled.schema).drop("component")


def omissions(matched: DataFrame, stems: DataFrame, key: str = "plot_id") -> DataFrame:
    """Stems (key, b_id, ...) in no pair; ids are unique in a plot."""
    return stems.join(matched.select(key, "b_id"), [key, "b_id"], "left_anti")


def commissions(matched: DataFrame, crowns: DataFrame, key: str = "plot_id") -> DataFrame:
    """Crowns (key, a_id, ...) in no pair; ids are unique in a plot."""
    return crowns.join(matched.select(key, "a_id"), [key, "a_id"], "left_anti")


def match_summary(matched: DataFrame, crowns: DataFrame, stems: DataFrame, key: str = "plot_id") -> DataFrame:
    """Counts, recall, precision, F1, height bias and RMSE (crown less stem) of each plot; null where undefined.

    Heights are ``a_height`` and ``b_height`` of the pairs; pairs that lack one are left out of bias and
    RMSE, and both are null where ``matched`` has no such columns.
    """
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    error = F.col("a_height") - F.col("b_height") if {"a_height", "b_height"} <= set(matched.columns) else F.lit(None).cast("double")
    pairs = matched.groupBy(key).agg(F.count(F.lit(1)).alias("matched"), F.avg("distance").alias("mean_offset_m"), F.avg(error).alias("height_bias_m"), F.sqrt(F.avg(error * error)).alias("height_rmse_m"))
    j = n(crowns, "detected").join(n(stems, "reference"), key, "full").join(pairs, key, "left").na.fill(0, ["detected", "reference", "matched"])
    recall, precision = F.try_divide("matched", "reference"), F.try_divide("matched", "detected")
    f1 = F.when(recall.isNotNull() & precision.isNotNull(), F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0)))
    missed, extra = F.col("reference") - F.col("matched"), F.col("detected") - F.col("matched")
    return j.select(key, "detected", "reference", "matched", missed.alias("omissions"), extra.alias("commissions"), recall.alias("recall"), precision.alias("precision"), f1.alias("f1"), "mean_offset_m", "height_bias_m", "height_rmse_m")
