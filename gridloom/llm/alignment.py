"""Alignment of two tokenizers' tokens by the bytes they cover, and how often each pair of ids overlaps in a corpus.

Texts are cut into units that both tokenizers encode apart (a space after anything but white space always starts
one), so that each unit of a batch is encoded and aligned once, however often it comes. Over all different
units of a batch, end to end, the tokens' byte lengths are added up to ends (cumsum); the ends that both
have (intersect1d) are the cuts of the groups, whose labels each token finds by its end (searchsorted); a token's
overlapping tokens are a range, and repeating each token over its range gives all links. Documents then take
their units' tokens, groups and links by repeating again. The links' pairs are added up within a document,
then by pair and salt, then by pair.

To score the documents, the most frequent pairs (MOST_COMMON at most) go to all tasks as arrays; only the pairs
beyond them are exploded and joined with their counts. So the hot pairs never meet in a shuffle.

Defined results: a text that is null or empty, isn't valid UTF-8, or that a tokenizer doesn't give back byte by byte has
no tokens: zeros and an empty ``groups``. Every row counts as a document, repeated rows included. Texts of any length are read whole, in
blocks. Of equally frequent pairs of an id all are best. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import as_bytes, bounded_batches, pieces, staged, staging, sums, table

#: Units of one block: what is aligned at once, of one or many documents.
BLOCK = 1 << 18
#: Units that a worker remembers, in each of two generations, and their longest, in characters.
REMEMBERED, LONGEST = 1 << 16, 48
#: Pairs whose counts are sent to all tasks.
MOST_COMMON = 1 << 18
#: Rows of one pair are added up in so many parts first.
SALTS = 16

_UNIT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:\s+$)?|\s+$")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_values() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: itself if it is printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers: the ids of units, and each id's bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        model = json.load(open(a_path, encoding="utf-8"))["model"]
        value = byte_values()
        spelled = {word: bytes(value[c] for c in word) for word in model["vocab"] if all(c in value for c in word)}
        ranks = {raw: model["vocab"][word] for word, raw in spelled.items()}
        joined = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if joined != sorted(joined):
            raise ValueError(f"{a_path}: ids don't follow the merges")
        most = joined[-1]
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v <= most}, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        if any(re.search("[^▁]▁", name) for name in names):
            raise ValueError(f"{b_path}: a piece goes on after a space")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        self.b_bytes = [bytes([int(n[3:-1], 16)]) if self._b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in v], dtype=np.int64) for v in (self.a_bytes, self.b_bytes))
        # An id with what follows it in a group's text: inside a side or at its end.
        self.a_text, self.b_text = (np.array([f"{i}," for i in range(len(v))] + [f"{i}{end}" for i in range(len(v))], dtype=object) for v, end in ((self.a_bytes, "|"), (self.b_bytes, ";")))
        self._young: dict = {}
        self._old: dict = {}

    def encode(self, units: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both for each unit (which starts with a space that B adds itself); None if one doesn't give it back."""
        found = [self._young.get(u) or self._old.get(u) for u in units]
        new = [i for i, f in enumerate(found) if f is None]
        b = self._b.encode([units[i][1:] for i in new], num_threads=1) if new else []
        for i, own_b in zip(new, b):
            unit = units[i]
            own_a, raw = self._a.encode_ordinary(unit), unit.encode()
            if b"".join([self.a_bytes[x] for x in own_a]) == raw == b"".join([self.b_bytes[x] for x in own_b]):
                found[i] = (own_a, own_b)
                if len(unit) <= LONGEST:
                    if len(self._young) >= REMEMBERED:
                        self._old, self._young = self._young, {}
                    self._young[unit] = found[i]
        return found


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two sequences of positive lengths over the same bytes: each A's and each B's group, how many B each A overlaps, and the links' A and B."""
    ends_a, ends_b = np.cumsum(a_lengths), np.cumsum(b_lengths)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    first = np.searchsorted(ends_b, ends_a - a_lengths, side="right")
    n = np.searchsorted(ends_b, ends_a) - first + 1
    link_a = np.repeat(np.arange(len(ends_a)), n)
    return group_a, group_b, n, link_a, spread(first, n)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] of them, for each i."""
    return np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)


class Units:
    """The different units of a block, aligned: counts, texts of groups, and pairs for each."""

    def __init__(self, p: Pair, units: list[str]):
        ids = p.encode(units)
        self.sound = np.array([x is not None for x in ids], dtype=bool)
        ids = [x or ([], []) for x in ids]
        self.n_a, self.n_b = (np.array([len(x[s]) for x in ids], dtype=np.int64) for s in (0, 1))
        a, b = (np.fromiter((i for x in ids for i in x[s]), dtype=np.int64, count=int(n.sum())) for s, n in ((0, self.n_a), (1, self.n_b)))
        group_a, group_b, n, link_a, link_b = overlaps(p.a_lengths[a], p.b_lengths[b])
        self.pairs = a[link_a] * len(p.b_bytes) + b[link_b]
        at_a = np.concatenate(([0], np.cumsum(self.n_a)))
        at_b = np.concatenate(([0], np.cumsum(self.n_b)))
        self.n_links = sums(n, at_a)
        self.first_link = np.cumsum(self.n_links) - self.n_links
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], [True] * bool(len(a))), np.append(group_b[1:] != group_b[:-1], [True] * bool(len(b)))
        self.n_groups = sums(last_a.astype(np.int64), at_a)
        # Where each token stands in the groups' text: after the tokens of its side and those of the other side in groups before.
        items = np.empty(len(a) + len(b), dtype=object)
        items[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = p.a_text[a + last_a * len(p.a_bytes)]
        items[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = p.b_text[b + last_b * len(p.b_bytes)]
        items, cuts = items.tolist(), (at_a + at_b).tolist()
        self.texts = ["".join(items[x:y]) for x, y in zip(cuts, cuts[1:])]


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Units with their texts' numbers and how many each has, BLOCK or a few more at once; a text may go on in the next block. What isn't UTF-8 has none."""
    units: list[str] = []
    docs: list[int] = []
    counts: list[int] = []
    for i, text in enumerate(texts):
        try:
            whole = " " + text.decode() if text else ""
        except UnicodeDecodeError:
            continue
        if not whole:
            continue
        found = (m.group() for m in _UNIT.finditer(whole))
        while own := list(islice(found, BLOCK)):
            units += own
            docs.append(i)
            counts.append(len(own))
            if len(units) >= BLOCK:
                yield units, docs, counts
                units, docs, counts = [], [], []
    if units:
        yield units, docs, counts


class Aligned:
    """What is known of a piece's texts, block after block."""

    def __init__(self, n: int, with_groups: bool):
        self.counts = np.zeros((4, n), dtype=np.int64)
        self.sound = np.ones(n, dtype=bool)
        self.hashes = [None] * n
        self.groups: list[list[str]] | None = [[] for _ in range(n)] if with_groups else None
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, p: Pair, units: list[str], docs: list[int], counts: list[int], bits: int) -> None:
        number: dict[str, int] = {}
        of = np.array([number.setdefault(u, len(number)) for u in units], dtype=np.int64)
        u = Units(p, list(number))
        at = np.concatenate(([0], np.cumsum(counts)))
        docs = np.array(docs)
        for row, values in enumerate((u.n_a, u.n_b, u.n_groups, u.n_links)):
            self.counts[row, docs] += sums(values[of], at)
        self.sound[docs] &= sums((~u.sound[of]).astype(np.int64), at) == 0
        texts, cuts, where = u.texts, at.tolist(), of.tolist()
        for i, x, y in zip(docs.tolist(), cuts, cuts[1:]):
            text = "".join([texts[j] for j in where[x:y]])
            if self.groups is not None:
                self.groups[i].append(text)
            if self.hashes[i] is None:
                self.hashes[i] = hashlib.sha256(text[:-1].encode())
            else:
                self.hashes[i].update(f";{text[:-1]}".encode())
        n = u.n_links[of]
        pairs = u.pairs[spread(u.first_link[of], n)]
        keys, times = np.unique(pairs | np.repeat(np.repeat(docs, counts), n) << bits, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)

    def pairs(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts' offsets, and their different pairs and how often each comes; texts without tokens have none."""
        keys, times = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (self.keys, self.times))
        if len(self.keys) > 1:
            keys, of = np.unique(keys, return_inverse=True)
            times = np.bincount(of, weights=times).astype(np.int64)
        stays = self.sound[keys >> bits]
        keys, times = keys[stays], times[stays]
        at = np.searchsorted(keys, np.arange(len(self.sound) + 1, dtype=np.int64) << bits)
        return at.astype(np.int32), keys & ((1 << bits) - 1), times


def linked(docs: DataFrame, text: str = "text", keep: list[str] | None = None, paths: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """The columns ``keep`` (of clashing names none) with n_a, n_b, n_groups, n_links, groups_sha256, and ``pairs``, ``times``: the different id pairs
    (A's id times B's vocabulary plus B's id) that overlap and how often; ``with_groups`` adds ``groups`` (a1,a2|b1;a3|b2,b3). One pass, no shuffle."""
    a_path, b_path = paths or default_paths()
    bounded_batches(docs.sparkSession)
    fields = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType())]
    fields += [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))] + [T.StructField("groups", T.StringType())] * with_groups
    own = {f.name for f in fields}
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c.lower() not in own]
    rows = docs.select(F.struct(F.lit(True).alias("_"), *[docs[f"`{c}`"] for c in keep]).alias("_row"), as_bytes(docs[f"`{text}`"]).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        bits = (len(p.a_bytes) * len(p.b_bytes)).bit_length()
        for batch in batches:
            for part in pieces(batch, "_text", 4 << 20):
                found = Aligned(part.num_rows, with_groups)
                for units, of, counts in _blocks(part.column(1).to_pylist()):
                    found.add(p, units, of, counts, bits)
                at, pairs, times = found.pairs(bits)
                some = [h is not None and ok for h, ok in zip(found.hashes, found.sound)]
                columns = [pa.array(c * found.sound) for c in found.counts] + [pa.array([h.hexdigest() if ok else "" for h, ok in zip(found.hashes, some)])]
                columns += [pa.ListArray.from_arrays(pa.array(at), pa.array(pairs)), pa.ListArray.from_arrays(pa.array(at), pa.array(times.astype(np.int32)))]
                if with_groups:
                    columns.append(pa.array(["".join(g)[:-1] if ok else "" for g, ok in zip(found.groups, some)]))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["_row", *[f.name for f in fields]])

    found = rows.mapInArrow(run, T.StructType([rows.schema["_row"], *fields]))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in keep], *[f.name for f in fields])


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """pair, n, best: in how many rows of ``links`` each pair is, and whether no pair of its A id is in more.

    Added up by pair and a salt, then by pair. An A id has no more pairs than B has ids, so no partition of the window is large.
    """
    from pyspark.sql import Window

    rows = links.select(F.explode("pairs").alias("pair"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    parts = rows.groupBy("pair", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / b_size)))
    return counts.select("pair", "n", (F.col("n") == top).alias("best"))


def _common(counts: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame]:
    """The rows beyond the most frequent ``most`` (None if there are none), and those up to them: all from a count on, told by a histogram of a few hundred powers."""
    power = F.floor(8 * F.log2("n"))
    room, least = most, None
    for r in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("power")).collect():
        if r["k"] > room:
            return counts.where(F.lit(True) if least is None else F.col("n") < least), counts.where(F.lit(False) if least is None else F.col("n") >= least)
        room, least = room - r["k"], r["least"]
    return None, counts


def scored(links: DataFrame, counts: DataFrame, most: int = MOST_COMMON) -> DataFrame:
    """``links`` (a written table) less pairs and times, with n_best (links whose pair is the best of its A id) and count_sum (the links' pairs' counts added up)."""
    rare, common = _common(counts, most)
    known = common.select("pair", "n", "best").toArrow()
    by = np.argsort(known["pair"].to_numpy())
    pairs, n, best = (np.asarray(known[c].to_numpy())[by] for c in ("pair", "n", "best"))
    columns = [c for c in links.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).offsets.to_numpy().astype(np.int64)
            own, times = (batch.column(i).values.to_numpy()[at[0] : at[-1]] for i in (1, 2))
            at = at - at[0]
            where = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            hit = pairs[where] == own if len(pairs) else np.zeros(len(own), dtype=bool)
            where = where[hit]
            times_hit = times[hit].astype(np.int64)
            best_sum, count_sum = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
            best_sum[hit], count_sum[hit] = times_hit * best[where], times_hit * n[where]
            rest = pa.array(np.concatenate(([0], np.cumsum(~hit)))[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums(best_sum, at)), pa.array(sums(count_sum, at)), pa.ListArray.from_arrays(rest, pa.array(own[~hit])), pa.ListArray.from_arrays(rest, pa.array(times[~hit]))],
                names=["_row", "n_best", "count_sum", "pairs", "times"],
            )

    rows = links.select(F.struct(*columns).alias("_row"), "pairs", "times")
    schema = T.StructType([rows.schema["_row"], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), rows.schema["pairs"], rows.schema["times"]])
    found = rows.mapInArrow(run, schema)
    if rare is None:
        return found.select("_row.*", "n_best", "count_sum")
    found = staged(found.withColumn("_id", F.monotonically_increasing_id()), "alignment-found")
    beyond = found.select("_id", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_id", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    beyond = beyond.join(rare, "pair").groupBy("_id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    add = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return found.drop("pairs", "times").join(beyond, "_id", "left").select("_row.*", add("n_best", "more_best"), add("count_sum", "more_sum"))


def apply(docs: DataFrame, text: str = "text", keep: list[str] | None = None, paths: tuple[str, str] | None = None, most: int = MOST_COMMON) -> DataFrame:
    """The columns ``keep``, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row."""
    paths = paths or default_paths()
    with staging(docs.sparkSession) as result:
        links = staged(linked(docs, text, keep, paths), "alignment-links")
        counts = staged(pair_counts(links, len(pair(*paths).b_bytes)), "alignment-counts")
        return result(scored(links, counts, most), "alignment-scored")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
