"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule.
Policies are versioned masks over those bits, applied later without touching a text again, and ablations
(what a policy would keep without one rule) come from grouped bitwise aggregation over the distinct bit
patterns, of which there are at most 2 ** len(RULES).

Cases: a null or empty text has no words (and fails rules that need words); very long texts are measured
whole; repeated rows each get their row; an empty table gives an empty ledger; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, per_batch

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_adjacent")
#: name -> failing condition; a rule's bit is its place here, so new rules only ever go to the end.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 20 * n_words",
    "stutter": "100 * n_adjacent > 40 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: version -> mask of the rules that reject.
POLICIES = {"base": BASE, "v1": BASE | BITS["symbols"] | BITS["duplicate_lines"], "v2": sum(BITS.values())}
#: The ledger's entry of one document, all rules compiled to one function.
failed_bits = eval(f"lambda {', '.join(MEASURES)}: {' + '.join(f'{BITS[n]} * ({r})' for n, r in RULES.items())}")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def repeat_words(words: list[str]) -> int:
    """Words inside 8-word windows that occur twice or more, first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    a = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        x = a[k : k + n] * _ODD[k]
        h += x ^ (x >> np.uint64(31))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    if not same.size:
        return 0
    hit = np.zeros(n, bool)
    for p in same.tolist():
        i, j = order[p], order[p + 1]
        if words[i : i + WINDOW] != words[j : j + WINDOW]:  # two windows with one hash: count by the words themselves
            first: dict[tuple, int] = {}
            hit[:] = False
            for at in range(n):
                w = tuple(words[at : at + WINDOW])
                if (was := first.setdefault(w, at)) != at:
                    hit[was] = hit[at] = True
            break
        hit[i] = hit[j] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    edge[starts] += 1
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD_RE.findall(text)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), lines, dup, repeat_words(words), sum(map(str.__eq__, words, words[1:]))


def _measured(batch: pa.RecordBatch):
    rows = [(*m, failed_bits(*m)) for m in map(measure, batch.column(1).to_pylist())]
    yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in zip(*rows)]], ["doc_id", *MEASURES, "failed_bits"])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, failed_bits long."""
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), _measured, "doc_id long, " + ", ".join(f"{x} long" for x in (*MEASURES, "failed_bits")))


def apply_policy(led: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    return led.withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version] | BASE)) == 0)


def ablations(led: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it."""
    mask = POLICIES[version]
    patterns = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    rows = [F.struct(F.lit(r).alias("rule"), *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("fails", F.col("bits").bitwiseAND(F.lit(b)) != 0), ("fails_alone", F.col("bits") == b), ("kept_without", F.col("bits").bitwiseAND(F.lit(mask & ~b)) == 0))]) for r, b in BITS.items() if mask & b]
    return patterns.agg(F.array(*rows).alias("r"), total.alias("documents")).select(F.explode("r").alias("x"), "documents").select("x.*", "documents")


def filter_documents(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The documents that a policy keeps, with their own columns: the ledger's bits meet the policy's mask in the pass
    that measures, so no text is shuffled."""
    schema = docs.schema
    at = schema.fieldNames().index("text")
    mask = POLICIES[version] | BASE

    def run(b):
        keep = [not mask & failed_bits(*measure(t)) for t in b.column(at).to_pylist()]
        yield b.filter(pa.array(keep, pa.bool_()))

    return per_batch(docs, run, schema)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT doc_id, sum(c) AS n_lines, sum(c - 1) AS n_dup_lines FROM lines GROUP BY doc_id),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
win AS (SELECT doc_id, i, ws[i:i + 7] AS g FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
      len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
      len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_adjacent
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
      (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
      + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
      + (CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_adjacent > 40 * n_words THEN 32 ELSE 0 END) AS failed_bits FROM m)
SELECT doc_id::BIGINT AS doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
 n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, failed_bits = 0 AS kept, failed_bits::BIGINT AS failed_bits FROM b
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")
