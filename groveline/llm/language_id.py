"""Language by nearest centroid: normalised TF-IDF vectors of hashed n-grams, several centroids a language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm import _words as W
from groveline.llm._shared import flat, read_table, slices

GRAMS, WIDTH = (1, 2, 3, 4), 1 << 12
CENTROIDS, ROUNDS = 4, 12
#: The classifier is fitted on about so many texts of each language (all, if it has fewer), chosen by a hash of doc_id.
SAMPLE = 600
#: Language counts are broadcast if there are no more languages than this.
MOST_BROADCAST = 10_000
#: A text farther from its centroid than this share of the training texts is marked as not accepted.
REJECT = 0.995
#: Texts whose vectors are in memory at once.
ROWS = 1024
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def counts(column: pa.Array) -> np.ndarray:
    """How often each hashed n-gram of bytes occurs in each text, lowered, with all but letters made spaces."""
    data, offsets = flat(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    rows = len(offsets) - 1
    out = np.zeros(rows * WIDTH, np.float32)
    data = _LETTERS[data].astype(np.uint64)
    of = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    h = np.zeros(0, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(data) < n:
            break
        h = data.copy() if n == 1 else (h[:-1] << np.uint64(8)) | data[n - 1 :]
        if n in GRAMS:
            slot = ((h + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int64)
            one = of[: len(h)] == of[n - 1 :]
            out += np.bincount(of[: len(h)][one] * WIDTH + slot[one], minlength=len(out)).astype(np.float32)
    return out.reshape(rows, WIDTH)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reach: np.ndarray  # greatest accepted distance of each centroid

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        x = np.log1p(raw) * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)

    def predict(self, raw: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        cosine = self.vectors(raw) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(float)
        return [self.langs[i] for i in best], score, 1 - score <= self.reach[best]


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from a farthest-first start; deterministic."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)
    chosen = [unit(x.mean(0))]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[(x @ np.array(chosen).T).max(1).argmin()])
    centre = np.array(chosen)
    for _ in range(ROUNDS):
        own = (x @ centre.T).argmax(1)
        centre = np.array([unit(x[own == j].mean(0)) if (own == j).any() else centre[j] for j in range(len(centre))])
    return centre


def train(rows: list[tuple[np.ndarray, str]]) -> Model | None:
    """From count vectors and their languages; None without any."""
    if not rows:
        return None
    raw, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 1).astype(np.float32)
    model = Model([], np.zeros((0, WIDTH), np.float32), idf, np.zeros(0))
    x = model.vectors(raw)
    parts = []
    for lang in sorted(set(labels)):
        parts.append(_clusters(x[labels == lang], CENTROIDS))
        model.langs += [str(lang)] * len(parts[-1])
    model.centroids = np.concatenate(parts).astype(np.float32)
    cosine = x @ model.centroids.T
    best = cosine.argmax(1)
    far = 1 - cosine[np.arange(len(best)), best]
    model.reach = np.array([np.quantile(far[best == j], REJECT) * 1.5 if (best == j).any() else 0.0 for j in range(len(model.langs))])
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from ``text`` and ``lang`` of rows that have both, a doc_id, and a letter in the text."""
    known = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    sizes = known.groupBy("lang").count()
    if len(sizes.limit(MOST_BROADCAST + 1).collect()) <= MOST_BROADCAST:
        sizes = F.broadcast(sizes)  # else the texts are dealt out by language
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = known.join(sizes, "lang").filter(unit < F.lit(sample) / F.col("count")).select("doc_id", "text", "lang")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19, ROWS):
            raw = counts(batch.column(1))
            at = [np.flatnonzero(r) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(raw, at, strict=True)], pa.list_(pa.float32()))], names=["doc_id", "lang", "at", "n"])

    found = chosen.mapInArrow(sparse, "doc_id long, lang string, at array<int>, n array<float>").orderBy("doc_id").toArrow()
    rows = []
    for lang, at, n in zip(found["lang"].to_pylist(), found["at"].to_pylist(), found["n"].to_pylist(), strict=True):
        x = np.zeros(WIDTH, np.float32)
        x[at] = n
        rows.append((x, lang))
    return train(rows)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, accepted for each row (doc_id, text).

    ``und`` with score 0, not accepted, if the text is null or has no letter, or nothing was learned.
    Texts of any length are read whole; repeated rows are judged alike; an empty table gives an empty one.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20, ROWS):
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model is None:
                lettered[:] = False
                langs, score, near = ["und"] * batch.num_rows, np.zeros(batch.num_rows), lettered
            else:
                langs, score, near = model.predict(counts(batch.column(1)))
            langs = [x if ok else "und" for x, ok in zip(langs, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(np.where(lettered, score, 0.0)), pa.array(near & lettered)], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(label, "doc_id long, lang_pred string, score double, accepted boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs.select("doc_id", "text", "lang").filter(rest != 2))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
