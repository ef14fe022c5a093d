"""The training-data pipeline: documents in, token ids of the clean ones out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. Where a stage changes texts, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm._shared import cut, read_table
from groveline.llm.byte_bpe import round_trip
from groveline.llm.decontaminate import decontaminate
from groveline.llm.line_dedup import line_dedup
from groveline.llm.minhash_dedup import minhash_dedup
from groveline.llm.quality_rules import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _retexted(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed."""
    judged = quality_rules(docs)
    return _retexted(judged.filter("quality.kept"), "quality.clean_text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose like came before, row by row; a document left without a word goes."""
    cleaned = line_dedup(docs, ("lang", "source")).filter(F.col("n_lines") > F.col("n_removed"))
    return _retexted(cleaned, "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: all rows of the least doc_id. Rows of a null doc_id stay."""
    # The verdict is one for all rows of a doc_id, and a null one matches nothing.
    gone = minhash_dedup(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; ``exact`` tells that they decode to its text."""
    out = round_trip(docs.select("doc_id", "lang", "source", "text"))
    exact = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", "lang", "source", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", exact.alias("exact"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("benchmark_decontamination", benchmark), ("byte_bpe", tokens)]

#: Karp-Rabin tiling and BPE merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
