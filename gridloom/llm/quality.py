"""Quality rules with host verdicts.

Every document is measured once (`measure`): words, repeated lines, repeated word windows, symbols.
Rules turn the measures into failures; failures are added up by host, each host's failure rate is
shrunk towards a beta prior fitted to all hosts, and hosts whose shrunk rate is too high are rejected.
A document is kept if it fails no rule itself and its host isn't rejected.

Defined results: a null or blank text has no words and fails the rule on length; a null host is no
host, so no verdict reaches its documents; repeated rows are judged alike and each is returned; an
empty table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import as_bytes, bounded_batches, flat, long, packed, row_map, staged, sums, table, unpacked, without

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; a document fails one by passing its limit."""

    min_words: int = 20
    repeat_percent: int = 30
    #: Symbols for each 100 words.
    symbol_percent: int = 100
    dup_line_percent: int = 50
    #: A host is rejected if its shrunk failure rate is over this. Its verdict also takes documents that fail
    #: nothing themselves, so it wants clearly more than half of them to fail, not just over a half.
    max_host_rate: float = 0.7


SPACE = b" \t\n\x0b\x0c\r"
_IS_WORD_CHAR = np.array([c not in SPACE and (c & 0xC0) != 0x80 for c in range(256)], dtype=np.uint8)
_IS_SYMBOL = np.array([c in b"#*$%&|<>" for c in range(256)], dtype=np.uint8)


def _codes(values: np.ndarray) -> np.ndarray:
    return pd.factorize(values)[0].astype(np.int64)


def repeat_words(words: list[bytes], counts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words covered by windows that occur twice or more in their text, for texts end to end.

    Windows get exact codes by doubling: codes of pairs, of pairs of pairs, and so on (width: a power of two).
    """
    out = np.zeros(len(counts), dtype=np.int64)
    n = len(words)
    if n < width:
        return out
    codes = _codes(np.array(words, dtype=object))
    step = 1
    while step < width:
        codes = _codes(codes[:-step] * n + codes[step:])
        step *= 2
    at = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    if not len(starts):
        return out
    own = _codes(codes[starts] * len(counts) + doc[starts])
    again = starts[np.bincount(own)[own] > 1]
    edge = np.bincount(again, minlength=n + 1) - np.bincount(again + width, minlength=n + 1)[: n + 1]
    return sums((np.cumsum(edge)[:n] > 0).astype(np.int64), at)


def _measures(column: pa.Array) -> list[pa.Array]:
    data, at = flat(column)
    texts = [t or b"" for t in column.to_pylist()]
    words: list[bytes] = []
    counts, lines, dups = [], [], []
    for text in texts:
        own = text.split()
        words += own
        counts.append(len(own))
        full = [x for x in text.split(b"\n") if x.strip()]
        lines.append(len(full))
        dups.append(len(full) - len(set(full)))
    n = np.array(counts, dtype=np.int64)
    return [long(n), long(sums(_IS_WORD_CHAR[data], at)), long(sums(_IS_SYMBOL[data], at)), long(lines), long(dups), long(repeat_words(words, n))]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text column and with MEASURES; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    rest = without(docs, text, *MEASURES)
    df = docs.select(F.struct(F.lit(True).alias("_"), *[docs[f"`{c}`"] for c in rest.columns]).alias("_row"), as_bytes(docs[f"`{text}`"]).alias("_text"))
    found = row_map(df, "_text", [T.StructField(m, T.LongType()) for m in MEASURES], lambda: _measures)
    return found.select(*[F.col("_row").getField(c).alias(c) for c in rest.columns], *MEASURES)


def judge(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds ``base_failed`` and ``failures`` (an array of the names of the rules that fail)."""
    n = F.col("n_words")
    failed = {
        "short": n < rules.min_words,
        "repeats": 100 * F.col("n_repeat_words") > rules.repeat_percent * n,
        "symbols": 100 * F.col("n_symbols") > rules.symbol_percent * n,
        "dup_lines": 100 * F.col("n_dup_lines") > rules.dup_line_percent * F.col("n_lines"),
    }
    names = F.array(*[F.when(c, F.lit(k)) for k, c in failed.items()])
    return without(measured, "base_failed", "failures").withColumn("base_failed", failed["short"] | failed["repeats"]).withColumn("failures", F.filter(names, lambda x: x.isNotNull()))


def host_rates(judged: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunk), host_rejected: a row for each host.

    The prior is fitted by moments: the mean m of all documents, and the variance between hosts less
    what sampling alone gives; its strength is m (1 - m) / variance - 1, held between 1 and a million.
    Hosts are added up before the shuffle, so a hot host costs no more than others.
    """
    hosts = staged(
        judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.size("failures") > 0).cast("long")).alias("n_failed")),
        "quality-hosts",
    )
    rate = F.col("n_failed") / F.col("n_docs")
    s = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(rate * F.col("n_failed")).alias("ff")).first()
    alpha, beta = prior(s["k"], s["n"] or 0, s["f"] or 0, s["ff"] or 0.0)
    shrunk = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", shrunk > rules.max_host_rate)


def prior(k: int, n: int, f: int, ff: float) -> tuple[float, float]:
    """alpha, beta from the number of hosts, documents, failures and the sum of failures times rates."""
    if not n:
        return 1.0, 1.0
    m = f / n
    spread = max(ff / n - m * m - m * (1 - m) * k / n, 1e-6)
    strength = min(max(m * (1 - m) / spread - 1, 1.0), 1e6)
    return max(m * strength, 1e-6), max((1 - m) * strength, 1e-6)


def rejected(judged: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """host: a row for each rejected host, a written table."""
    return staged(host_rates(judged, host, rules).where("host_rejected").select("host"), "quality-rejected")


def verdicts(judged: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``judged`` with ``kept``. Only rejected hosts are joined; both sides are tables, so Spark can split a hot host."""
    rest = without(judged, "kept")
    work = packed(rest, rest[f"`{host}`"].alias("_host"), (F.size("failures") == 0).alias("_good"))
    joined = work.join(rejected(judged, host, rules), F.col("_host") == F.col("host"), "left")
    return joined.select(*[F.col("_row").getField(c).alias(c) for c in rest.columns], (F.col("_good") & F.col("host").isNull()).alias("kept"))


def apply(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The columns of ``docs`` but the text, the measures, base_failed, failures and kept."""
    return verdicts(judge(staged(measure(docs, text), "quality-measures"), rules), host, rules)


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with their columns.

    The texts are measured twice, for the hosts and then to choose documents, as that costs less than to
    hold them on disk meanwhile or to join them back; a join follows only if a host was rejected.
    """
    bounded_batches(docs.sparkSession)
    bad = rejected(judge(measure(docs.select("source", "text")), rules), "source", rules)
    marked = row_map(packed(docs, as_bytes(F.col("text")).alias("_text")), "_text", [T.StructField(m, T.LongType()) for m in MEASURES], lambda: _measures)
    good = judge(marked, rules).where(F.size("failures") == 0).select("_row")
    if not bad.isEmpty():
        good = good.join(bad, F.col("_row.source") == F.col("host"), "left_anti")
    return unpacked(good, docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return apply(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines AS failed
  FROM m),
h AS (SELECT source, count(*) AS n, sum(failed::INT) AS f FROM j WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS m, sum(f * (f / n)) / sum(n) AS q FROM h),
t AS (SELECT *, least(greatest(m * (1 - m) / greatest(q - m * m - m * (1 - m) * k / n, 1e-6) - 1, 1.0), 1e6) AS z FROM s),
b AS (SELECT h.source FROM h, t WHERE (f + greatest(m * z, 1e-6)) / (h.n + greatest(m * z, 1e-6) + greatest((1 - m) * z, 1e-6)) > 0.7)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT failed AND NOT EXISTS (SELECT 1 FROM b WHERE b.source = j.source) AS kept
FROM j
"""
