"""Operator 10: quality rules as a bitmask ledger.

Every rule is evaluated once for each document. What is stored is a ledger: the measurements and one
64-bit mask with a bit for each rule that failed. A versioned policy is only a mask over those bits, so
changing or comparing policies never reads a text again, and ablations are bitwise aggregates.

Defined cases: a null text counts as empty (no words: it fails `few_words`); null doc_ids and repeated rows
give one row each; documents of any length are measured whole; an empty table gives an empty ledger; only the
named id and text columns are read, so further columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlink.llm.common import map_columns, table

SPACE, SYMBOLS, WINDOW = " \t\n\v\f\r", "#*$%&|<>", 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_stutter")


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements holds. bit: its place in the mask, never reused."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "long_words", "word_chars > 14 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "digits", "100 * n_digits > 30 * word_chars"),
    Rule(7, "stutter", "100 * n_stutter > 30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the decision: the names of the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask_of(self.rules)


def mask_of(names) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


BASE = Policy("base", ("few_words", "repeated_windows"))
#: Repeated lines and many digits also occur in sound documents (page furniture, contact data), so only STRICT has them.
V1 = Policy("v1", ("few_words", "repeated_windows", "symbols", "long_words", "short_words", "stutter"))
STRICT = Policy("strict", tuple(r.name for r in RULES))


def repeated_words(words: list) -> int:
    """Words that lie in a window of five words found twice or more in the list."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    if len(seen) <= 4096:  # five ids of 12 bits fill one key
        keys = ids[:n].copy()
        for k in range(1, WINDOW):
            keys = keys << 12 | ids[k : n + k]
    else:  # the window's first k words are numbered anew each time, so keys stay exact
        keys = ids[:n]
        for k in range(1, WINDOW):
            _, ranks = np.unique(keys, return_inverse=True)
            keys = ranks.astype(np.int64) * len(seen) + ids[k : n + k]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: exactly 0x20 and 0x09 to 0x0D part words
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(text.count, "0123456789")),
        sum(map(eq, words, words[1:])),
    )


def _measurer():
    def call(ids, texts):
        rows = list(zip(*map(measure, texts), strict=True))
        return {"doc_id": ids, **dict(zip(MEASURES, rows, strict=True))}

    return call


def fail_bits() -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, every measurement, fail_bits."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return map_columns(rows, _measurer, schema).withColumn("fail_bits", fail_bits())


def fail_bits_of(docs: DataFrame, text_col: str = "text", columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The given columns of docs with their measurements and fail_bits, row by row."""
    kept = docs.select(*columns)
    schema = kept.withColumns({m: F.lit(None).cast("long") for m in MEASURES}).schema
    at = list(columns).index(text_col)

    def make():
        def call(*values):
            rows = list(zip(*map(measure, values[at]), strict=True))
            return {**dict(zip(columns, values, strict=True)), **dict(zip(MEASURES, rows, strict=True))}

        return call

    return map_columns(kept, make, schema).withColumn("fail_bits", fail_bits())


def failed(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(ledger_rows: DataFrame, policy: Policy = V1) -> DataFrame:
    return ledger_rows.withColumn("base_failed", failed(BASE)).withColumn("kept", ~failed(policy))


def ablations(ledger_rows: DataFrame, policy: Policy = V1) -> DataFrame:
    """For each rule of the policy: documents it fails, documents that it alone rejects (which dropping the rule
    would keep), and documents rejected in all. One aggregate over the distinct masks, at most 2^rules rows."""
    masks = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules))
    each = masks.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (F.bit_count("bits") == 1), F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "n_lines", "n_digits", "n_stutter")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, in all and alone, over the whole ledger."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


def ledger_sql(source: str) -> str:
    """The ledger of `source` (doc_id, text; distinct ids) in DuckDB SQL."""
    fails = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
u AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER d AS w1, lead(w, 2) OVER d AS w2, lead(w, 3) OVER d AS w3, lead(w, 4) OVER d AS w4 FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2, w3, w4) AS n FROM g WHERE w4 IS NOT NULL),
z AS (SELECT doc_id, count(*) AS n FROM g WHERE w = w1 GROUP BY doc_id),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM k, (SELECT unnest(generate_series(0, 4)) AS j) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits, coalesce(z.n, 0)::BIGINT AS n_stutter
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN z USING (doc_id)),
f AS (SELECT *, ({fails})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE.mask}) <> 0 AS base_failed,
       (fail_bits & {V1.mask}) = 0 AS kept, fail_bits, n_lines, n_digits, n_stutter FROM f"""


_BITS = ", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES if r.name in V1.rules)
ABLATIONS = f"""
SELECT rule, sum(((fail_bits & bit) <> 0)::INT)::BIGINT AS n_failed, sum(((fail_bits & {V1.mask}) = bit)::INT)::BIGINT AS n_alone,
       sum(((fail_bits & {V1.mask}) <> 0)::INT)::BIGINT AS n_rejected
FROM ({ledger_sql("documents")}) l, (VALUES {_BITS}) r(rule, bit) GROUP BY rule"""

QUERIES = {"op10_quality_rules": op10_quality_rules, "quality_ablations": quality_ablations}
ORACLES = {"op10_quality_rules": ledger_sql("documents"), "quality_ablations": ABLATIONS}
