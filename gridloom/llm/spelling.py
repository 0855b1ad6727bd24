"""Spelling variants of a corpus's words, found by a rare-first filter of positional bigrams.

Words are counted document by document and added up. Of the counted words the bigrams are put in one order,
the rarest first, and each word looks for others by its three rarest only: one edit touches two bigrams at
most, so two words that one edit tells apart keep one of each other's three rarest in common, in its place or
(if a code point was inserted before it) one further on. The edit is then wholly to the right of that bigram,
and the words agree up to it, or wholly to the left, and they agree from it on. So rows meet on the bigram's
place from the start together with what leads to it, or on its place from the end together with what follows,
and on their lengths. That is the position limit as an equality, and it leaves few rows for each key. What
meets is verified as one edit inside the join, so no pair that isn't near ever leaves it.

Defined results: a null or empty text has no words; a null document number counts as an empty one; every row is
counted, repeated rows included; runs and texts of any length are read whole; of equally frequent forms the
smallest in code-point order is taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, bounded_batches, staged, staging, table, unstaged

#: Rarest bigrams of a word that are looked up: one more than an edit can touch.
RAREST = 3
#: Different words that a task adds up before it hands them on.
HELD = 1 << 17
#: One of so many runs of a document loses a code point (test noise that the query's contract asks for).
NOISE = 199

#: Of Latin-1: A to Z in lower case, other letters as they are, all else a space.
_RUNS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def runs(text: bytes) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF as Latin-1, A-Z in lower case. Other characters become ``?`` and so end a run."""
    return text.decode("utf-8", "replace").encode("latin-1", "replace").translate(_RUNS).split()


def _counted(least_length: int, noise: int | None):
    """word, n: what the rows of a task hold, added up as far as HELD allows."""

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        crc = zlib.crc32
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(w for w in runs(text) if len(w) >= least_length) if text else {}
                if noise:
                    start, changed = crc(key.encode() + b":"), []
                    for w in own:
                        h = crc(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if not h % noise:
                            changed.append((w, h % len(w)))
                    for w, at in changed:
                        # The shorter word may be one of the document's own; what it becomes isn't changed again.
                        held[w[:at] + w[at + 1 :]] += own.pop(w)
                held.update(own)
                if len(held) >= HELD:
                    yield out(held)
                    held = Counter()
        if held:
            yield out(held)

    return run


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = 6, least_count: int = 5, noise: int | None = None) -> DataFrame:
    """word, n: words of ``least_length`` code points and ``least_count`` occurrences or more.

    ``noise`` makes one of so many (document, run) lose a code point, chosen by a checksum of both.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[f"`{key}`"].cast("string"), F.lit("")).alias("key"), as_bytes(docs[f"`{text}`"]).alias("text"))
    counted = rows.mapInArrow(_counted(least_length, noise), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Each bigram's place in the order of frequency among ``words``, rarest first, ties by the bigram. Words have 90 letters, so there are 8,100 at most."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    found = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    return {r["gram"]: i for i, r in enumerate(sorted(found, key=lambda r: (r["n"], r["gram"])))}


def rarest(word: str, ranks: dict[str, int], most: int = RAREST) -> list[int]:
    """Places of the rarest bigrams, ties by place."""
    return [i for _, i in sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))[:most]]


def _keys(ranks: dict[str, int]):
    """word, n, size, keys: for each of the rarest bigrams what leads to it and what follows from it on, as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = lambda x, side: xxhash.xxh64_intdigest(x.encode(), side) - (1 << 63)
        for batch in batches:
            words = batch.column(0).to_pylist()
            keys = [list({k for i in rarest(w, ranks) for k in (h(w[: i + 2], 0), h(w[i:], 1))}) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["word", "n", "size", "keys"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of ``words`` (word, n; distinct, of four code points or more) that one edit tells apart, once."""
    ranks = bigram_ranks(words)
    keyed = staged(words.select("word", "n").mapInArrow(_keys(ranks), "word string, n long, size int, keys array<long>"), "spelling-keys")
    # Words of one length differ by a replacement, and the smaller looks for the larger; of two lengths the shorter looks for the longer.
    left = keyed.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("size").alias("size_a"), F.explode("keys").alias("k"))
    left = left.select("a", "n_a", "size_a", "k", F.explode(F.array(F.col("size_a"), F.col("size_a") + 1)).alias("size"))
    right = keyed.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "size", F.explode("keys").alias("k"))
    met = left.join(right, (left["k"] == right["k"]) & (left["size"] == right["size"]) & ((left["size_a"] < right["size"]) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the steps word -> form end. Each step multiplies the count, so a few doublings reach every end."""
    reached = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = reached.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = staged(reached.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        unstaged(reached)
        reached = step
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root for each of ``words`` (word, n): its number of near words, the most frequent of
    them if it occurs ``factor`` times as often or more, and where following forms ends."""
    with staging(words.sparkSession) as result:
        words = staged(words.select("word", "n"), "spelling-words")
        pairs = staged(near_pairs(words), "spelling-pairs")
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
        best = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("form"))).alias("best")
        near = both.groupBy(F.col("a").alias("_word")).agg(F.count(F.lit(1)).alias("n_near"), best)
        form_n = -F.col("best.n")
        formed = form_n >= factor * F.col("n")
        found = words.join(near, F.col("word") == F.col("_word"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, form_n).alias("form_n"))
        found = staged(found, "spelling-found")
        ends = roots(found.where("form IS NOT NULL")).withColumnRenamed("word", "_word")
        return result(found.join(ends, F.col("word") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "spelling-variants")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(table(spark, sf_dir, "documents"), noise=NOISE)
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
