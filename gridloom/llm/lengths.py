"""Exact histogram of encoded lengths, with suffix sums for every context limit.

Documents are encoded and counted by length before any shuffle, so what moves is one row for each length
and task. Suffix sums are taken within bands of BAND lengths and then over the bands' totals, so no window
holds more than BAND lengths or the number of bands.

Defined results: a null or empty text has length 0 and counts as a document; repeated rows count each; equal
lengths are one row; a text of any length is encoded whole; an empty table gives an empty histogram and no
limits' rows; columns other than the text are ignored, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import bpe
from gridloom.llm.common import staged, staging, table

BAND = 1024


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """n_tokens, n_docs: how many rows have each length."""
    return lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """``hist`` with, for its length L as a context limit:

    docs_longer, tokens_longer: documents over L and their tokens; total_docs, total_tokens: of all documents;
    truncated_tokens: of all documents cut to L; lost_tokens: what the cut loses; at_most_share: the share
    of documents of length L or less.
    """
    hist = staged(hist.withColumn("_band", F.floor(F.col("n_tokens") / BAND)), "lengths")
    tokens = F.col("n_tokens") * F.col("n_docs")
    bands = hist.groupBy("_band").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    after = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = staged(
        bands.select(
            "_band",
            F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_da"),
            F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_ta"),
            F.sum("_d").over(whole).alias("total_docs"),
            F.sum("_t").over(whole).alias("total_tokens"),
        ),
        "length-bands",
    )
    own = Window.partitionBy("_band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    within = hist.select("*", F.coalesce(F.sum("n_docs").over(own), F.lit(0)).alias("_dw"), F.coalesce(F.sum(tokens).over(own), F.lit(0)).alias("_tw"))
    longer, tokens_longer = F.col("_da") + F.col("_dw"), F.col("_ta") + F.col("_tw")
    cut = F.col("total_tokens") - tokens_longer + F.col("n_tokens") * longer
    return within.join(bands, "_band").select(
        "n_tokens",
        "n_docs",
        longer.alias("docs_longer"),
        tokens_longer.alias("tokens_longer"),
        "total_docs",
        "total_tokens",
        cut.alias("truncated_tokens"),
        (F.col("total_tokens") - cut).alias("lost_tokens"),
        ((F.col("total_docs") - longer) / F.col("total_docs")).alias("at_most_share"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_tokens, docs_longer for any limits, also those that no document has: one aggregation for all.

    Each length is dealt to the limits it is within, and each limit keeps its largest length.
    """
    wanted = F.array(*[F.lit(x).cast("long") for x in sorted(set(limits))])
    within = sums.select("*", F.explode(F.filter(wanted, lambda x: x >= F.col("n_tokens"))).alias("limit"))
    best = within.groupBy("limit").agg(F.max(F.struct("n_tokens", "docs_longer", "tokens_longer", "total_tokens")).alias("b"))
    found = best.select("limit", (F.col("b.total_tokens") - F.col("b.tokens_longer") + F.col("limit") * F.col("b.docs_longer")).alias("truncated_tokens"), F.col("b.docs_longer").alias("docs_longer"))
    # Limits below every length: all documents are longer.
    least = sums.agg(F.min("n_tokens").alias("least"), F.max("total_docs").alias("n")).where("n IS NOT NULL")
    below = least.select("n", F.explode(F.filter(wanted, lambda x: x < F.col("least"))).alias("limit"))
    return found.unionByName(below.select("limit", (F.col("limit") * F.col("n")).alias("truncated_tokens"), F.col("n").alias("docs_longer")))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """n_tokens: the smallest length that a share q of the documents doesn't exceed.

    That share is reached at a whole number of documents, the smallest one that is q of them or more; q counts as the decimal it is written as.
    """
    part = Fraction(str(q))
    # n - docs_longer >= q n, in whole numbers.
    enough = (F.col("total_docs") - F.col("docs_longer")).cast("decimal(20,0)") * part.denominator >= F.col("total_docs").cast("decimal(20,0)") * part.numerator
    return sums.where(enough).agg(F.min("n_tokens").alias("n_tokens"))


def op8_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    with staging(spark) as result:
        return result(suffix_sums(histogram(bpe.token_counts(table(spark, sf_dir, "documents"), keep=[]))), "length-sums")
