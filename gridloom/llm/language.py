"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs, made from its code point and the seed alone. A
trigram's vector binds its letters' (the first rotated twice, the second once, multiplied sign by sign);
a text's vector bundles (adds up) those of all its trigrams; a language's prototype bundles those of its
labelled texts. A text gets the language whose prototype has the largest cosine with it. Runs of
characters that aren't letters count as one space; each text starts and ends with one.

In training each text's vector is scaled to the same length and rounded to whole UNITs, so that a very
long text weighs no more than others and sums don't depend on how rows are dealt out. What is gathered is
DIMENSIONS numbers for each language; over MAX_LANGUAGES different labels raise ValueError, so the
model's size has a bound. Trigrams are bundled BLOCK at a time, and a long text is read whole but in segments
of SEGMENT bytes, each like a text of its own whose vectors are added up, so that memory doesn't grow with a
text's length beyond the text itself.

Defined results: `und` with score 0 for a null text, one without a letter, or if no language was learned;
equal cosines give the language that sorts first; a null language isn't learned from; a null doc_id is
neither held out nor learned from; repeated rows count each; an empty table gives an empty result; input
columns named like an output column are replaced.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import as_bytes, bounded_batches, packed, pieces, row_map, table, unpacked, without

DIMENSIONS = 1024
MAX_LANGUAGES = 4096
UNKNOWN = "und"
#: The length to which a text's vector is scaled in training.
UNIT = 1 << 16
#: Bytes of text, trigrams and texts that are in work at once.
SEGMENT, BLOCK, GROUPS = 256 << 10, 4096, 512
#: Numbers of texts by trigrams that are counted at once.
DENSE = 2 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


@lru_cache(100_000)
def letter_vector(point: int, seed: int, size: int) -> np.ndarray:
    """Random signs; point 0 is the space between words."""
    return (np.random.default_rng([seed, point]).integers(0, 2, size, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """points (k, 3) of the k different trigrams; for each occurrence its text and its row in points."""
    lowered = [f"\n{t.decode('utf-8', 'replace').lower()}\n" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.array([len(t) for t in lowered])
    starts = np.cumsum(size) - size
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    at = np.flatnonzero(keep)
    text = np.repeat(np.arange(len(texts)), size)[at]
    symbols = np.where(letter[at], points[at], 0)
    alphabet, code = np.unique(symbols, return_inverse=True) if len(symbols) < 4096 else _dense(symbols)
    k = len(alphabet)
    code = code.astype(np.int64)
    ok = text[:-2] == text[2:]
    tri = ((code[:-2] * k + code[1:-1]) * k + code[2:])[ok]
    if k**3 <= 4_000_000:
        present = np.flatnonzero(np.bincount(tri, minlength=1))
        row = np.zeros(k**3, dtype=np.int64)
        row[present] = np.arange(len(present))
        tri = row[tri]
    else:
        present, tri = np.unique(tri, return_inverse=True)
    found = np.stack((present // (k * k), present // k % k, present % k), axis=1) if len(present) else np.zeros((0, 3), dtype=np.int64)
    return alphabet[found], text[:-2][ok], tri


def _dense(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(int(symbols.max()) + 1, dtype=bool)
    seen[symbols] = True
    alphabet = np.flatnonzero(seen)
    row = np.zeros(len(seen), dtype=np.int64)
    row[alphabet] = np.arange(len(alphabet))
    return alphabet, row[symbols]


def bind(points: np.ndarray, seed: int, size: int) -> np.ndarray:
    """Vectors of trigrams."""
    alphabet, code = np.unique(points, return_inverse=True)
    own = np.stack([letter_vector(int(c), seed, size) for c in alphabet]) if len(alphabet) else np.zeros((1, size), np.int8)
    a, b, c = code.reshape(-1, 3).T
    return np.roll(own, 2, axis=1)[a] * np.roll(own, 1, axis=1)[b] * own[c]


def bundle(group: np.ndarray, tri: np.ndarray, points: np.ndarray, groups: int, seed: int, size: int) -> np.ndarray:
    """Sum of the vectors of each group's trigrams, BLOCK trigrams at a time; sums of whole numbers, exact in float32 below 2**24."""
    out = np.zeros((groups, size), dtype=np.float32)
    starts = range(0, len(points), BLOCK)
    if groups * len(points) <= DENSE:
        counts = np.bincount(group * len(points) + tri, minlength=groups * len(points)).reshape(groups, -1).astype(np.float32)
        for a in starts:
            out += counts[:, a : a + BLOCK] @ bind(points[a : a + BLOCK], seed, size).astype(np.float32)
        return out
    # Many texts with many different trigrams: their counts are made block by block, too.
    order = np.argsort(tri, kind="stable")
    group, tri = group[order], tri[order]
    for a, i, j in zip(starts, *(np.searchsorted(tri, [s + d for s in starts]) for d in (0, BLOCK))):
        some = points[a : a + BLOCK]
        counts = np.bincount(group[i:j] * len(some) + tri[i:j] - a, minlength=groups * len(some)).reshape(groups, -1)
        out += counts.astype(np.float32) @ bind(some, seed, size).astype(np.float32)
    return out


def segments(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces of SEGMENT bytes at most, cut after the last white space of a piece, or between characters if it has none."""
    at = 0
    while len(text) - at > SEGMENT:
        end = max(text.rfind(c, at, at + SEGMENT) for c in (b" ", b"\n", b"\t")) + 1
        if not end:
            end = at + SEGMENT
            while text[end] & 0xC0 == 0x80 and end > at + 1:
                end -= 1
        yield text[at:end]
        at = end
    yield text[at:]


def vectors(texts: list[bytes | None], seed: int, size: int) -> np.ndarray:
    """The bundle of each text, as whole numbers; zero for one without a letter."""
    out = np.zeros((len(texts), size))
    todo = [(i, s) for i, t in enumerate(texts) if t for s in segments(t)]
    at = 0
    while at < len(todo):
        end, held = at, 0
        while end < len(todo) and (end == at or (held + len(todo[end][1]) <= SEGMENT and end - at < GROUPS)):
            held += len(todo[end][1])
            end += 1
        points, own, tri = trigrams([s for _, s in todo[at:end]])
        if len(tri):
            of, found = [i for i, _ in todo[at:end]], bundle(own, tri, points, end - at, seed, size)
            if len(set(of)) == len(of):
                out[of] += found
            else:
                np.add.at(out, of, found)
        at = end
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prototypes: np.ndarray
    seed: int

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return best, score
        found = vectors(texts, self.seed, self.prototypes.shape[1])
        norm = np.sqrt((found**2).sum(axis=1))
        own = self.prototypes / np.maximum(np.sqrt((self.prototypes**2).sum(axis=1, keepdims=True)), 1e-12)
        # Rounded, so that equal prototypes have equal cosines in whatever order they are added up.
        cosine = np.round(found @ own.T / np.maximum(norm, 1e-12)[:, None], 12)
        top = cosine.argmax(axis=1)
        for i in np.flatnonzero(norm):
            best[i], score[i] = self.languages[top[i]], min(max(cosine[i, top[i]], 0.0), 1.0)
        return best, score


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", seed: int = 7, size: int = DIMENSIONS) -> Model:
    """Prototypes of all rows with a language."""
    spark = labelled.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, "_text", SEGMENT):
                found = vectors(part.column(1).to_pylist(), seed, size)
                unit = np.rint(found * (UNIT / np.maximum(np.sqrt((found**2).sum(axis=1, keepdims=True)), 1))).astype(np.int64)
                for n, v in zip(part.column(0).to_pylist(), unit):
                    if n in held:
                        held[n] += v
                    elif v.any():
                        held[n] = v.copy()
        for n, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([n] * size), pa.array(np.arange(size, dtype=np.int32)), pa.array(v)], names=["lang", "place", "value"])

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), as_bytes(F.col(text)).alias("_text"))
    sums = rows.mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found = sums.limit(MAX_LANGUAGES * size + 1).toPandas()
    if len(found) > MAX_LANGUAGES * size:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    languages = sorted(found["lang"].unique())
    prototypes = np.zeros((len(languages), size))
    prototypes[found["lang"].map({n: i for i, n in enumerate(languages)}).to_numpy(dtype=int), found["place"].to_numpy(dtype=int)] = found["value"]
    return Model(languages, prototypes, seed)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) with ``lang_pred`` and ``score``."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (without(docs, text).columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]

    def each(column: pa.Array) -> list[pa.Array]:
        best, score = sent.value.predict(column.to_pylist())
        return [pa.array(best, pa.string()), pa.array(score)]

    row = F.struct(F.lit(True).alias("_"), *[docs[f"`{c}`"] for c in keep])
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    found = row_map(docs.select(row.alias("_row"), as_bytes(docs[f"`{text}`"]).alias("_text")), "_text", fields, lambda: each, most=SEGMENT)
    return found.select(*[F.col("_row").getField(c).alias(c) for c in keep], "lang_pred", "score")


def remainder():
    """Which quarter of the documents a document is in, by its number."""
    return F.crc32(F.col("doc_id").cast("string")) % 4


def keep(docs: DataFrame, min_score: float = 0.1) -> DataFrame:
    """The documents with a recognised language: not `und`, and a cosine of ``min_score`` or more. Learned from the documents' own labels."""
    model = train(docs.where(remainder() != 2).select("text", "lang"))
    found = predict(packed(docs, F.col("text")), model)
    return unpacked(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)), docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(remainder() != 2).select("text", "lang"))
    marked = docs.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "text")
    return predict(marked, model)
