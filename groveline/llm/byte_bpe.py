"""Byte-level BPE by a rank queue over a hierarchical bitmap.

The symbols of pre-tokens are a doubly linked list, with a bar after each pre-token that nothing
merges with. Each rank has a bucket of left positions whose pair had that rank when it was put in; a
two-level bitmap tells which buckets hold anything, and find-first-set on it gives the next rank.
Entries that no longer match the list are skipped. A merge costs O(1) whatever the length, so
pre-tokens of megabytes take linear time, and short ones share the queue of many.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from groveline.llm._shared import read_table, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers; it is kept in two generations. Results don't depend on it.
REMEMBERED, LONGEST = 250_000, 64
#: Bytes of pre-tokens that are merged together; a longer one is merged alone.
TOGETHER = 1 << 17
#: The id of a bar.
BAR = 0xFFFFF

_BIT = [1 << i for i in range(256)]


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.double = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pairs: dict[int, int] = {}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pair(self, key: int) -> int:
        """The rank of a pair of ids (left << 20 | right), or -1; remembers it."""
        rank = self.ranks.get(self.bytes_of[key >> 20] + self.bytes_of[key & 0xFFFFF], -1)
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[key] = rank
        return rank

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers. Of equal ranks the leftmost pair goes first, as in the usual merge loop.

        ``buckets``: positions by rank; ``words``: a bit for each rank that waits, 256 to a word;
        ``summary``: a bit for each word with a bit.
        """
        points = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64)
        n = len(points)
        bars = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
        symbols = self.single[points]
        symbols[bars] = BAR
        ranks = np.append(self.double[points[:-1] << 8 | points[1:]], -1)
        ranks[bars] = -1
        ranks[bars[1:] - 1] = -1
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        waiting, starts = np.unique(ranks[at], return_index=True)
        at, starts, waiting = at.tolist(), [*starts.tolist(), len(at)], waiting.tolist()
        buckets = {r: at[starts[i] : starts[i + 1]] for i, r in enumerate(waiting)}
        words, summary = [0] * (len(self.bytes_of) + 255 >> 8), 0
        for r in waiting:
            words[r >> 8] |= _BIT[r & 255]
            summary |= 1 << (r >> 8)
        ids, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, lookup = self.pairs, self.pairs.get
        while summary:
            word = (summary & -summary).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << 8 | low.bit_length() - 1
            bits ^= low
            words[word] = bits
            if not bits:
                summary ^= 1 << word
            bucket = buckets.pop(rank)
            if len(bucket) > 1:
                bucket.sort()
            left = rank << 20
            for place, i in enumerate(bucket):
                x = ids[i]
                if x < 0:
                    continue  # stale
                j = after[i]
                y = ids[j]
                if y == BAR:
                    continue  # stale
                key = x << 20 | y
                known = lookup(key)
                if (self.pair(key) if known is None else known) != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                k = after[i] = after[j]
                before[k] = i
                sooner = False
                y = ids[k]
                if y != BAR:
                    key = left | y
                    new = lookup(key)
                    if new is None:
                        new = self.pair(key)
                    if new >= 0:
                        sooner = new <= rank
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            words[new >> 8] |= _BIT[new & 255]
                            summary |= 1 << (new >> 8)
                h = before[i]
                x = ids[h]
                if x != BAR:
                    key = x << 20 | rank
                    new = lookup(key)
                    if new is None:
                        new = self.pair(key)
                    if new >= 0:
                        sooner |= new <= rank
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            buckets[new] = [h]
                            words[new >> 8] |= _BIT[new & 255]
                            summary |= 1 << (new >> 8)
                if sooner and place + 1 < len(bucket):  # what has come goes before what is left of this bucket
                    if rank in buckets:
                        buckets[rank] += bucket[place + 1 :]
                    else:
                        buckets[rank] = bucket[place + 1 :]
                        words[rank >> 8] |= _BIT[rank & 255]
                        summary |= 1 << (rank >> 8)
                    break
        out = np.array(ids)
        out[bars] = -1
        kept = out >= 0
        packed, edges = out[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept)[bars]).tolist()
        return [packed[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. What no memory holds of all texts is merged together."""
        split = [self.split.findall(t) for t in texts]
        known: dict[str, bytes] = {}
        fresh, part, size = [], [], 0
        memory, older = self.memory, self.older
        merged = lambda: known.update(zip(part, self.merge([p.encode() for p in part]), strict=True))
        for piece in set().union(*split):
            packed = memory.get(piece)
            if packed is None:
                packed = older.get(piece)
                if packed is None:
                    fresh.append(piece)
                    whole = self.ranks.get(piece.encode())
                    if whole is None:
                        part.append(piece)
                        size += len(piece)
                        if size >= TOGETHER:
                            merged()
                            part, size = [], 0
                        continue
                    packed = whole.to_bytes(4, "little")
                else:
                    fresh.append(piece)
            known[piece] = packed
        if part:
            merged()
        for piece in fresh:
            if len(piece) <= LONGEST:
                if len(self.memory) >= REMEMBERED:
                    self.older, self.memory = self.memory, {}
                self.memory[piece] = known[piece]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def forget(self) -> None:
        self.memory, self.older, self.pairs = {}, {}, {}

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(4)
def load(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """The vocabulary of a rank file (each line: token in base64, rank); the public one by default."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return ByteBPE(ranks, pattern or public_tokenizers.PATTERN)


def _with(df: DataFrame, steps: list[tuple[str, str, Callable[[ByteBPE], Callable[[list], list]]]], path: str | None, pattern: str | None) -> DataFrame:
    """``df`` and for each step (source, target, function) a binary column, made in slices of bounded bytes by one worker.

    A worker forgets its pre-tokens at the end of a task, so that they aren't held while others work."""
    df = df.drop(*(target for _, target, _ in steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        try:
            for batch in slices(batches, steps[0][0]):
                for source, target, f in steps:
                    values = batch.column(batch.schema.get_field_index(source)).to_pylist()
                    batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(f(bpe)(values), pa.binary())], names=[*batch.schema.names, target])
                yield batch
        finally:
            bpe.forget()

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(target, BinaryType()) for _, target, _ in steps)]))


_ENCODE = ("text", "token_ids", lambda bpe: lambda texts: bpe.encode_all([t or "" for t in texts]))
_DECODE = ("token_ids", "decoded", lambda bpe: lambda packed: [bpe.decode(x or b"") for x in packed])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``token_ids`` (binary: ids as little-endian u32).

    Null text is empty: no ids. Rows are independent; a column already so named is replaced.
    The vocabulary is read where the executors run, by ``path``.
    """
    return _with(docs, [_ENCODE], path, pattern)


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``tokens`` and ``decoded`` (binary: the bytes that ``token_ids`` stand for); null ids are none."""
    return _with(tokens, [_DECODE], path, pattern)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``decode(encode(docs))``, by one worker a task instead of two."""
    return _with(docs, [_ENCODE, _DECODE], path, pattern)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
