"""License scans by diagonal voting.

Each position of each document gives the hashes of its next words, for each gram length that a template
votes by, and Spark joins these hashes to the template positions: phrases and notices of fewer than SHORT
words vote by PAIR words, so that one changed word leaves some votes, longer notices by RUN words. A hit
votes for the diagonal document position less template position. Votes are added up by document, template
and diagonal; diagonals at most GAP words apart are merged, as words put in or left out shift the later
ones; spans with enough votes (the merged one, and that of its strongest diagonal) are cut from the text and
verified by edit distance. The base phrases are found by the same votes: a diagonal on which all of a
phrase's grams hit is a place.

Hashes are made where the text is read, 8 bytes a gram, and don't leave the task: the templates' table is of
known size, so up to BROADCAST_ROWS positions it is sent to all executors; beyond that Spark chooses the
join. Votes are added up by diagonal in the task, too. With them goes, once for each stretch of CHUNK words (or
the longest notice's) in which a notice's diagonal starts, the stretch's text and what a span from there on can
have: at most some three times the text, however many diagonals vote, and no text is shuffled whole or read
again to verify spans. Hits are few and keyed by document, so no step gathers a common phrase of many documents.

Defined results: a null or blank text has no words, no place, no label and score 0; a text of any length is
scanned whole; repeated rows (equal doc_id and text) get equal results; of spans that start within GAP words
of each other the most similar counts, of equal ones that of the label that sorts last; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import LOWER_ALNUM, as_bytes, bounded_batches, long, row_map, staged, staging, table
from gridloom.llm.notices import NOTICES, PHRASES

PAIR, RUN, SHORT, GAP = 2, 4, 10, 3
#: Share of a notice's grams that must vote (of short ones, of others), and similarity by edit distance that a span must have.
SHORT_VOTES, MIN_VOTES, MIN_SIMILAR = 0.4, 0.2, 0.8
BROADCAST_ROWS = 100_000
#: Bytes of text whose hashes, some four times as many, are in work at once.
PIECE = 256 << 10
#: Fewest words of a stretch of text that is carried for verification.
CHUNK = 256

_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def words(text: bytes | None) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, A to Z lower-cased."""
    return (text or b"").translate(LOWER_ALNUM).split()


def hashes(own: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, own), dtype=np.uint64, count=len(own))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words (given by theirs) from each position on; k is a part of it."""
    if len(h) < k:
        return np.zeros(0, dtype=np.int64)
    n = len(h) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = out * _MIX[0] + h[i : i + n]
    out = (out ^ (out >> np.uint64(30))) * _MIX[1]
    out = (out ^ (out >> np.uint64(27))) * _MIX[2]
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def width(n: int, phrase: bool) -> int:
    """Words of a gram by which a template of n words votes."""
    return min(n, PAIR if phrase or n < SHORT else RUN)


def votes_needed(n: int, phrase: bool) -> int:
    """Grams of a template of n words that must vote for a span."""
    of = n - width(n, phrase) + 1
    return of if phrase else max(1, -(-round(1000 * (SHORT_VOTES if n < SHORT else MIN_VOTES)) * of // 1000))


_TEMPLATE = "template int, label string, phrase boolean, body string, length int, needed int, k int, place int, gram long"


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> tuple[DataFrame, list[int], int, int]:
    """A row for each gram of each template, the gram lengths in use, the words of a stretch, and the bytes that a span may need."""
    rows, kinds, chunk, most = [], set(), CHUNK, 0
    for number, (label, text, phrase) in enumerate([*((v, k, True) for k, v in phrases.items()), *((*x, False) for x in notices)]):
        own = words(text.encode())
        k = width(len(own), phrase)
        if not phrase:
            chunk, most = max(chunk, len(own)), max(most, 2 * len(b" ".join(own)))
        for place, gram in enumerate(grams(hashes(own), k).tolist() if own else []):
            kinds.add(k)
            rows.append((number, label, phrase, b" ".join(own).decode(), len(own), votes_needed(len(own), phrase), k, place, gram))
    df = spark.createDataFrame(rows, _TEMPLATE)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df, sorted(kinds), chunk, most


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``_text`` (bytes), k1, k2: two hashes that stand for the row."""
    bounded_batches(docs.sparkSession)
    key, text = F.col(f"`{key}`"), F.col(f"`{text}`")
    return docs.select(key, as_bytes(text).alias("_text"), F.xxhash64(key, text).alias("k1"), F.xxhash64(F.lit("second"), text, key).alias("k2"))


def votes(rows: DataFrame, known: DataFrame, kinds: list[int], chunk: int, most: int) -> DataFrame:
    """k1, k2, template columns, diagonal, at (position), place, excerpt: the hits, and for each of a notice a row
    without a template: ``diagonal`` is the number of the stretch of ``chunk`` words in which the hit's diagonal starts,
    ``excerpt`` its normalised text and ``most`` bytes after it: no span that is similar enough has more.
    """

    def make():
        def each(column: pa.Array) -> list[pa.Array]:
            counts, norms, starts, found = [], [], [], []
            for text in column.to_pylist():
                own = words(text)
                counts.append(len(own))
                norms.append(b" ".join(own))
                ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int32, count=len(own)) + 1, dtype=np.int32)
                starts.append(np.concatenate((np.zeros(1, np.int32), ends[:-1]))[: len(own)])
                h = hashes(own)
                found += [grams(h, k) for k in kinds]
            at = np.cumsum([0, *map(len, found)])[:: len(kinds)].astype(np.int32) if kinds else np.zeros(len(counts) + 1, np.int32)
            heads = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), pa.array(np.concatenate([*starts, np.zeros(0, np.int32)])))
            return [pa.array(counts, pa.int32()), pa.array(norms, pa.binary()), heads, pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*found, np.zeros(0, dtype=np.int64)])))]

        return each

    fields = [T.StructField("n", T.IntegerType()), T.StructField("norm", T.BinaryType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("grams", T.ArrayType(T.LongType()))]
    hashed = row_map(rows, "_text", fields, make, ["k1", "k2"], PIECE)
    hits = hashed.select("k1", "k2", "n", "norm", "starts", F.posexplode("grams").alias("i", "gram")).join(known, "gram")
    # A text's grams lie one length after the other.
    before = F.lit(0)
    for k in kinds:
        before = before + F.when(F.col("k") > k, F.greatest(F.col("n") - k + 1, F.lit(0))).otherwise(0)
    hits = hits.withColumn("at", F.col("i") - before)
    hits = hits.withColumn("diagonal", F.col("at") - F.col("place"))
    number = F.expr(f"CAST(greatest(diagonal, 0) DIV {chunk} AS INT)")
    head, size = F.get("starts", number * chunk), F.octet_length("norm")
    stop = F.coalesce(F.get("starts", (number + 1) * chunk), size) + most
    excerpt = F.struct(F.substring("norm", head + 1, stop - head).alias("data"), (size > stop).alias("more"))
    names = ["template", "label", "phrase", "body", "length", "needed", "diagonal", "at", "place"]
    none = F.lit(None).cast(excerpt_type := "struct<data:binary,more:boolean>")
    own = F.struct(*names, none.alias("excerpt"))
    text = F.struct(*[F.lit(None).cast(known.schema[n].dataType).alias(n) for n in names[:6]], number.alias("diagonal"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("place"), excerpt.cast(excerpt_type).alias("excerpt"))
    return hits.select("k1", "k2", F.explode(F.when(F.col("phrase"), F.array(own)).otherwise(F.array(own, text))).alias("v")).select("k1", "k2", "v.*")


def diagonals(hits: DataFrame) -> DataFrame:
    """k1, k2, template columns, diagonal, voted (places), first, last (positions): votes by diagonal, added up before
    they are shuffled; and the stretches of text, with their excerpt."""
    by = hits.groupBy("k1", "k2", "template", "label", "phrase", "body", "length", "needed", "diagonal")
    return by.agg(F.collect_set("place").alias("voted"), F.min("at").alias("first"), F.max("at").alias("last"), F.first("excerpt", True).alias("excerpt"))


def places(voted: DataFrame) -> DataFrame:
    """k1, k2, label, at: places of phrases, diagonals on which every gram hits."""
    return voted.where("phrase AND size(voted) = needed").select("k1", "k2", "label", F.col("diagonal").cast("long").alias("at"))


def spans(voted: DataFrame) -> DataFrame:
    """k1, k2, label, body, start, stop: spans of notices with votes enough, diagonals merged, and those of their strongest diagonals."""
    order = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int"), F.lit(0))
    merged = voted.where("NOT phrase").withColumn("new", new).withColumn("group", F.sum("new").over(order))
    by = merged.groupBy("k1", "k2", "template", "label", "body", "length", "needed", "group").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("voted")))).alias("n"),
        F.min_by("diagonal", F.struct("first", "diagonal")).alias("head"),
        F.max_by("diagonal", F.struct("last", "diagonal")).alias("stop"),
        F.max_by("diagonal", F.struct(F.size("voted"), -F.col("diagonal"))).alias("top"),
    )
    ends = F.array(F.struct(F.col("head").alias("start"), F.col("stop")), F.struct(F.col("top").alias("start"), F.col("top").alias("stop")))
    one = by.where("n >= needed").select("k1", "k2", "label", "body", "length", F.explode(ends).alias("e"))
    return one.select("k1", "k2", "label", "body", F.greatest("e.start", F.lit(0)).alias("start"), (F.col("e.stop") + F.col("length")).alias("stop")).distinct()


def verified(found: DataFrame, voted: DataFrame, chunk: int) -> DataFrame:
    """k1, k2, label, start, stop, similarity of the spans that their text bears out; of those that start close by each other, the most similar."""
    texts = voted.where("template IS NULL").select("k1", "k2", F.col("diagonal").alias("_chunk"), "excerpt")
    near = found.withColumn("_chunk", F.expr(f"CAST(start DIV {chunk} AS INT)")).join(texts, ["k1", "k2", "_chunk"])
    at, n = F.col("start") - F.col("_chunk") * chunk, F.col("stop") - F.col("start")
    near = near.withColumn("own", F.split(F.col("excerpt.data").cast("string"), " "))
    # Where a stretch ends before the text does, its last word may be cut and a longer span is too long to be similar.
    within = ~F.col("excerpt.more") | (F.size("own") - at > n)
    each = near.where((n > 0) & within).withColumn("cut", F.array_join(F.slice("own", at + 1, n), " "))
    longer, shorter = F.greatest(F.length("cut"), F.length("body")), F.least(F.length("cut"), F.length("body"))
    similar = F.when(shorter >= MIN_SIMILAR * longer, 1 - F.levenshtein("cut", "body") / longer)
    good = each.withColumn("similarity", similar).where(F.col("similarity") >= MIN_SIMILAR).select("k1", "k2", "label", "body", "start", "stop", "similarity").distinct()
    order = Window.partitionBy("k1", "k2").orderBy("start", "stop", "label", "body")
    new = F.coalesce((F.col("start") - F.lag("start").over(order) > GAP).cast("int"), F.lit(0))
    grouped = good.withColumn("new", new).withColumn("group", F.sum("new").over(order))
    return grouped.groupBy("k1", "k2", "group").agg(F.max(F.struct("similarity", "label", "start", "stop")).alias("s")).select("k1", "k2", "s.label", "s.start", "s.stop", "s.similarity")


def sized(rows: DataFrame, key: str) -> DataFrame:
    """``key``, k1, k2 and n_words of every row."""
    return row_map(rows, "_text", [T.StructField("n_words", T.LongType())], lambda: lambda c: [long([len(words(t)) for t in c.to_pylist()])], [key, "k1", "k2"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """``key`` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each row."""
    rows = keyed(docs, key, text)
    with staging(docs.sparkSession) as result:
        known, kinds, chunk, most = templates(docs.sparkSession, phrases, notices)
        voted = staged(diagonals(votes(rows, known, kinds, chunk, most)), "license-diagonals")
        base = places(voted).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_base"), F.min("at").alias("first_word"), F.max("at").alias("last_word"), F.collect_set("label").alias("base"))
        more = verified(spans(voted), voted, chunk).groupBy("k1", "k2").agg(F.collect_set("label").alias("more"), F.max("similarity").alias("best"), F.collect_set(F.struct("label", "start", "stop")).alias("spans"))
        marks = result(base.join(more, ["k1", "k2"], "full"), "license-marks")
    none = F.array().cast("array<string>")
    own, other = F.coalesce("base", none), F.coalesce("more", none)
    return sized(rows, key).join(marks, ["k1", "k2"], "left").select(
        F.col(f"`{key}`"),
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, other)), ",").alias("labels"),
        F.when(F.size(own) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.array_sort(F.coalesce("spans", F.array().cast("array<struct<label:string,start:int,stop:int>>"))).alias("spans"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
