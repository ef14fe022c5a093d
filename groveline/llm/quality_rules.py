"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much goes too."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from groveline.llm._shared import read_table, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 8

#: Punctuation: more than this share (%) of a line's word characters are symbols or marks of shouting.
MARKS = re.compile(r"[#*$%&|<>{}\[\]\\~^=!?]")
MOST_MARKS = 12
#: The patterns below see a line with A-Z lowered, and only ASCII classes, so that SQL reads them alike.
#: Navigation: separators between items, or nothing but a menu's words.
SEPARATOR = re.compile(r"(?:^|[\x20\t])(?:\||>|»|·|•|::|/)(?:[\x20\t]|$)")
MOST_SEPARATORS = 2
MENU = re.compile(r"^[^0-9a-z_]*(?:home|menu|login|log in|sign in|sign up|register|search|next|previous|prev|back|share|print|reply|read more|more|top|contact|contact us|about|about us|sitemap|skip to content)[^0-9a-z_]*$")
#: Boilerplate: phrases of legal lines, consent banners and scripts.
PHRASE = re.compile(r"all rights reserved|copyright[ \t]+(?:\(c\)|©|[0-9]{4})|©[ \t]*[0-9]{4}|terms of (?:use|service)|privacy policy|cookie policy|uses cookies|accept (?:all )?cookies|subscribe to our|click here|enable javascript|lorem ipsum|licensed under|permission is hereby granted|without warranty of any kind|powered by wordpress")
#: A document needs this share (%) of its word characters to survive.
LEAST_LEFT = 50


_SPACES = " \t\n\v\f\r"
_MARKS, _SYMBOLS, _SEPARATORS = "#*$%&|<>{}[]\\~^=!?", "#*$%&|<>", "|>»·•/:"
#: A line with a phrase has one of these when A-Z are lowered, so texts without them need no search.
_TRIGGERS = ("rights reserved", "copyright", "©", "terms of", "privacy policy", "cookie", "subscribe to", "click here", "javascript", "lorem ipsum", "licensed under", "permission is", "without warranty", "powered by")


def _solid(text: str) -> int:
    """Characters in words."""
    return len(text) - sum(map(text.count, _SPACES))


def _lower(text: str) -> str:
    """A-Z lowered, nothing else."""
    return text.encode().lower().decode()


def line_verdict(line: str, solid: int, marks: bool = True, separators: bool = True, phrases: bool = True) -> str | None:
    """The first rule that a line with a word fails, or None. The flags tell what its text may hold at all."""
    if marks and 100 * sum(map(line.count, _MARKS)) > MOST_MARKS * solid:
        return "punctuation"
    low = _lower(line)
    if separators and len(SEPARATOR.findall(line)) > MOST_SEPARATORS or MENU.match(low):
        return "navigation"
    if phrases and PHRASE.search(low):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words in ``n``-word windows that the text has twice or more, the first included."""
    if len(set(words)) == len(words):
        return 0
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + n - max(i, upto)
            upto = i + n
    return total


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text."""
    text = text or ""
    words = text.encode().split()  # bytes part at exactly \x20 and \x09-\x0D
    chars = _solid(text)
    folded = _lower(text)
    may = (any(c in text for c in _MARKS), any(c in text for c in _SEPARATORS), any(t in folded for t in _TRIGGERS))
    seen, dup, left, lines = set(), 0, 0, []
    for line in text.split("\n"):
        solid = _solid(line)
        if not solid:
            lines.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if line_verdict(line, solid, *may) is None:
            lines.append(line)
            left += solid
    repeat = repeated_words(words)
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    kept = not failed and 100 * left >= LEAST_LEFT * chars
    return len(words), chars, sum(map(text.count, _SYMBOLS)), dup, repeat, failed, kept, "\n".join(lines)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")
_KINDS = pa.struct([(c, pa.bool_() if c in ("base_failed", "kept") else pa.string() if c == "clean_text" else pa.int64()) for c in COLUMNS])


def quality_rules(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and struct ``quality``: the counts, base_failed, kept and clean_text.

    Null text is empty: no words, so base_failed. Rows are judged one by one (repeated rows alike);
    a column already named ``quality`` is replaced. Blank lines stay as they are. Texts of any length are
    judged whole; an empty table gives an empty one.
    """
    docs = docs.drop("quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            judged = [dict(zip(COLUMNS, judge(t), strict=True)) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(judged, _KINDS)], names=[*batch.schema.names, "quality"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("quality", from_arrow_type(_KINDS))]))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in COLUMNS[:-1]))


def _sql() -> str:
    q = lambda p: "'" + p.pattern.replace("'", "''") + "'"
    low = "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {q(WORD)}) AS w FROM documents),
lines AS (SELECT rid, s, i, list_sum(list_transform(regexp_extract_all(s, {q(WORD)}), lambda x: length(x))) AS solid
    FROM (SELECT rid, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d) WHERE regexp_matches(s, {q(WORD)})),
judged AS (SELECT rid, solid, row_number() OVER (PARTITION BY rid, s ORDER BY i) AS nth,
    NOT (100 * len(regexp_extract_all(s, {q(MARKS)})) > {MOST_MARKS} * solid OR len(regexp_extract_all(s, {q(SEPARATOR)})) > {MOST_SEPARATORS} OR regexp_matches({low}, {q(MENU)}) OR regexp_matches({low}, {q(PHRASE)})) AS ok FROM lines),
per AS (SELECT rid, count(*) FILTER (nth > 1) AS dup, coalesce(sum(solid) FILTER (ok), 0) AS remain FROM judged GROUP BY rid),
win AS (SELECT rid, unnest(range(1, len(w) - {WINDOW - 2})) AS p, w FROM d WHERE len(w) >= {WINDOW}),
keyed AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, array_to_string(w[p:p+{WINDOW - 1}], ' ')) AS n FROM win),
rep AS (SELECT rid, count(DISTINCT p + o) AS n FROM keyed, (SELECT unnest(range(0, {WINDOW})) AS o) WHERE n > 1 GROUP BY rid),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, {q(SYMBOL)}))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(remain, 0) AS remain FROM d LEFT JOIN per USING (rid) LEFT JOIN rep USING (rid)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * remain >= {LEAST_LEFT} * word_chars AS kept FROM failed"""


SQL = _sql()
