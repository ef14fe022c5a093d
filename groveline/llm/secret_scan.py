"""Secrets in text, by DataFrame expressions only (no Python on the executors, no shuffle).

Three regular expressions give the base spans. Beside them, long runs of token characters are
candidate strings: a window of 20 characters slides over each, its Shannon entropy is kept by
incremental counts (one character in, one out) in whole millionths of ``c * log2(c)``, and windows
above the threshold of the candidate's character class are merged into spans. Candidates on the
allow-list (UUIDs, runs of the alphabet or of digits, documentation placeholders) are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm._shared import read_table

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the runs of AKIA[A-Z0-9]+ with 18 characters or more
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ with 16 or more
ASSIGN_VALUE = 12

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least entropy of a window in bits a character, by class; a candidate needs a letter and a digit in either.
BITS = {"entropy_hex": 3.0, "entropy_mixed": 3.75}
ALLOWED = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Dd][Uu][Mm][Mm][Yy]|0123456789|abcdefgh|ABCDEFGH"
TERMS = [0, *(round(1e6 * c * math.log2(c)) for c in range(1, WINDOW + 1))]
LIMITS = {k: math.floor(1e6 * WINDOW * (math.log2(WINDOW) - bits)) for k, bits in BITS.items()}


def _prefix_sums(lengths: str) -> str:
    """Sum of all entries before each, in two levels so that long arrays aren't copied entry by entry."""
    inner = f"aggregate(slice({lengths}, b * 256 + 1, 256), named_struct('t', o.t, 'out', cast(array() AS array<int>)), (i, x) -> named_struct('t', i.t + x, 'out', concat(i.out, array(i.t))))"
    return f"""aggregate(sequence(0, size({lengths}) div 256), named_struct('t', 0, 'out', cast(array() AS array<array<int>>)),
        (o, b) -> transform(array({inner}), r -> named_struct('t', r.t, 'out', concat(o.out, array(r.out))))[0], o -> flatten(o.out))"""


def with_matches(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Add ``name``: array<struct<a, b, s>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    none = F.expr("cast(array() AS array<struct<a: int, b: int, s: string>>)")
    df = df.withColumn("_found", F.regexp_extract_all(text, F.lit(pattern), 0))
    df = df.withColumn("_gap", F.when(F.size("_found") > 0, F.transform(F.split(text, pattern, -1), F.length)))
    df = df.withColumn("_len", F.expr("transform(_found, (s, i) -> _gap[i] + length(s))"))
    df = df.withColumn("_at", F.when(F.size("_found") > 0, F.expr(_prefix_sums("_len"))))
    spans = F.expr("transform(_found, (s, i) -> named_struct('a', _at[i] + _gap[i], 'b', _at[i] + _gap[i] + length(s), 's', s))")
    return df.withColumn(name, F.when(F.size("_found") > 0, spans).otherwise(none)).drop("_found", "_gap", "_len", "_at")


def _entropy_spans(text: str, codes: str, limit: str) -> str:
    """Merged windows of a candidate: state is the counts by character, the sum of ``c * log2(c)``, and the spans so far."""
    terms = f"array({', '.join(map(str, TERMS))})"
    step = f"""(z, i) -> transform(array(named_struct('in', {codes}[i], 'out', if(i >= {WINDOW}, {codes}[greatest(i - {WINDOW}, 0)], -1))), e ->
        transform(array(if(e.in = e.out, z.sum, z.sum + {terms}[z.n[e.in] + 1] - {terms}[z.n[e.in]] + if(e.out < 0, 0, {terms}[z.n[greatest(e.out, 0)] - 1] - {terms}[z.n[greatest(e.out, 0)]]))), total ->
        named_struct('n', transform(z.n, (x, k) -> x + if(k = e.in, 1, 0) - if(k = e.out, 1, 0)), 'sum', total, 'out',
            if(i < {WINDOW - 1} OR total > {limit}, z.out,
               if(size(z.out) > 0 AND z.out[greatest(size(z.out) - 1, 0)].b >= i - {WINDOW - 1},
                  concat(slice(z.out, 1, size(z.out) - 1), array(named_struct('a', z.out[size(z.out) - 1].a, 'b', i + 1))),
                  concat(z.out, array(named_struct('a', i - {WINDOW - 1}, 'b', i + 1)))))))[0])[0]"""
    return f"""aggregate(sequence(0, length({text}) - 1), named_struct('n', array_repeat(0, {len(ALPHABET)}), 'sum', 0, 'out', cast(array() AS array<struct<a: int, b: int>>)), {step}, z -> z.out)"""


def secret_scan(docs: DataFrame) -> DataFrame:
    """All of ``docs`` with ``secrets``: array<struct<a, k, b>> by start, then kind (``k`` counts in ``KINDS``).

    Null text is empty: no secrets. A row is judged by itself, so repeated rows get equal results;
    other columns pass through, but those named ``secrets`` or with this operator's ``_`` names are replaced.
    """
    df = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX), ("_cand", CANDIDATE)):
        df = with_matches(df, "_text", pattern, name)
    df = df.withColumn("_assign", F.filter("_assign", lambda m: F.length(F.regexp_extract(m.s, ASSIGN, 2)) >= ASSIGN_VALUE))
    fit = F.filter("_cand", lambda m: m.s.rlike("[0-9]") & m.s.rlike("[A-Za-z]") & ~m.s.rlike(ALLOWED))
    df = df.withColumn("_cand", F.transform(fit, lambda m: F.struct(m.a.alias("a"), m.s.alias("s"), m.s.rlike("^[0-9A-Fa-f]+$").alias("hex"), F.transform(F.slice(F.split(m.s, "", -1), 1, F.length(m.s)), lambda c: F.instr(F.lit(ALPHABET), c) - 1).alias("codes"))))
    spans = _entropy_spans("m.s", "m.codes", f"if(m.hex, {LIMITS['entropy_hex']}, {LIMITS['entropy_mixed']})")
    more = f"flatten(transform(_cand, m -> transform({spans}, x -> named_struct('a', m.a + x.a, 'k', if(m.hex, 3, 4), 'b', m.a + x.b))))"
    base = [F.expr(f"transform({c}, m -> named_struct('a', m.a, 'k', {k}, 'b', m.b))") for k, c in enumerate(("_assign", "_access", "_hex"))]
    out = df.withColumn("secrets", F.array_sort(F.concat(*base, F.expr(more))))
    return out.drop("_text", "_assign", "_access", "_hex", "_cand")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m.k), m.a.cast("string"), m.b.cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("secrets", lambda m: m.k == k)).cast("long")
    base = F.filter("secrets", lambda m: m.k <= 2)
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    part = lambda name, pattern, keep: f"""{name} AS (SELECT rid, i, found[i] AS s, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda g: length(g))), 0))::BIGINT AS a
        FROM (SELECT rid, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, {q(pattern)}) AS found, string_split_regex(t, {q(pattern)}) AS gaps FROM d)) WHERE {keep})"""  # noqa: E731
    terms = f"[{', '.join(map(str, TERMS))}]"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{part('assign', ASSIGN, f"length(regexp_extract(found[i], {q(ASSIGN)}, 2)) >= {ASSIGN_VALUE}")},
{part('access', ACCESS, 'true')},
{part('hex', HEX, 'true')},
{part('cand', CANDIDATE, f"regexp_matches(found[i], '[0-9]') AND regexp_matches(found[i], '[A-Za-z]') AND NOT regexp_matches(found[i], {q(ALLOWED)})")},
win AS (SELECT *, regexp_full_match(s, '[0-9A-Fa-f]+') AS is_hex, unnest(range(0, length(s) - {WINDOW - 1})) AS o FROM cand),
chars AS (SELECT rid, i, a, is_hex, o, string_split(substr(s, o + 1, {WINDOW}), '') AS cs FROM win),
hot AS (SELECT * FROM chars WHERE list_sum(list_transform(list_distinct(cs), lambda c: {terms}[len(list_filter(cs, lambda e: e = c)) + 1])) <= CASE WHEN is_hex THEN {LIMITS['entropy_hex']} ELSE {LIMITS['entropy_mixed']} END),
brk AS (SELECT *, CASE WHEN o - lag(o) OVER (PARTITION BY rid, i ORDER BY o) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM hot),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, i ORDER BY o) AS g FROM brk),
spans AS (SELECT rid, 0 AS k, a, a + length(s) AS b FROM assign UNION ALL SELECT rid, 1, a, a + length(s) FROM access UNION ALL SELECT rid, 2, a, a + length(s) FROM hex
    UNION ALL SELECT rid, CASE WHEN any_value(is_hex) THEN 3 ELSE 4 END, min(a + o), max(a + o) + {WINDOW} FROM isl GROUP BY rid, i, g),
named AS (SELECT *, [{', '.join(map(q, KINDS))}][k + 1] || ':' || a || ':' || b AS n FROM spans),
agg AS (SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(n, ',' ORDER BY a, k) FILTER (k <= 2) AS base, string_agg(n, ',' ORDER BY a, k) AS every FROM named GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN agg USING (rid)"""


SQL = _sql()
