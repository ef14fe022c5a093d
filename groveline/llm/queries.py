"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from groveline.llm import byte_bpe, decontaminate, html_extract, language_id, line_dedup, minhash_dedup, quality_rules, secret_scan, substring_dedup, warc_archive

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_warc_archive": warc_archive.op5_warc_archive,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_language_id": language_id.op9_language_id,
    "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op1_secret_scan": secret_scan.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_quality_rules": quality_rules.SQL,
    "op5_warc_archive": warc_archive.SQL,
    "op10_minhash_dedup": minhash_dedup.SQL,
}
