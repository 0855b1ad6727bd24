"""Byte-level BPE without a regular expression.

Pre-tokenisation. Code points become classes by table look-up; a class says besides what only looking
ahead can tell (a space before a non-space, a contraction). Each class is a function from the state of
an eight-state machine to its next state. The functions that composing them can give form a small
monoid, held as one multiplication table, so the machine runs as an associative scan over function
numbers: within blocks all columns at once, then over the blocks' totals, then boundaries are looked up
from (state before, class). The machine cuts as the split pattern of the rank files does.

Merging. The slices between boundaries are looked up in a cache of merged slices; all misses of a piece
of input are merged together, a round of numpy operations for each merge level: in every slice the
pair with the lowest rank (the leftmost of equal ones) is joined until no pair has a rank. The cache
is emptied when it holds CACHE_SLICES.

Decoding. The offset of every id in its text is the running sum of the ids' lengths. The vocabulary's bytes
lie end to end, so that the bytes of all ids are gathered from there to their offsets at once.

Defined results: a null or empty text has no ids; every byte sequence that is valid UTF-8 comes back as
it was; repeated rows are each encoded; an empty table gives an empty result; input columns named like
an output column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import as_bytes, bounded_batches, long, row_map, table

#: Slices that a worker's cache holds before it is emptied (some 30 MB).
CACHE_SLICES = 150_000
#: The code points of Unicode's White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in a contraction.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

# Classes. SPACE: a space before a non-space. BLANK: another white space before a non-space. WHITE: white space before white space or the end.
LETTER, NUMBER, OTHER, SPACE, BLANK, WHITE, SHORT, LONG, END = range(9)
# States: what the last code point was part of. FREE: nothing, so that the next one starts a slice.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state], starts[class, state]."""
    nxt = np.zeros((9, 8), dtype=np.uint8)
    starts = np.ones((9, 8), dtype=bool)
    for kind, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        nxt[kind] = run
        starts[kind, [run, AFTER_SPACE]] = False
    nxt[LETTER, ONE_MORE], nxt[LETTER, TWO_MORE] = FREE, ONE_MORE
    starts[LETTER, [ONE_MORE, TWO_MORE]] = False
    nxt[SPACE], nxt[BLANK], nxt[WHITE] = AFTER_SPACE, FREE, IN_WHITE
    starts[WHITE, IN_WHITE] = False
    for kind, state in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        nxt[kind] = state
        nxt[kind, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        starts[kind, [IN_OTHER, AFTER_SPACE]] = False
    nxt[END] = FREE
    return nxt, starts


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """generator number of each class; table[f, g] = f then g; next state of FREE under each function."""
    nxt, _ = _machine()
    functions: dict[bytes, int] = {bytes(range(8)): 0}
    order = [bytes(range(8))]
    for f in order:
        for g in nxt:
            h = bytes(g[list(f)])
            if h not in functions:
                functions[h] = len(order)
                order.append(h)
    mult = np.array([[functions[bytes(np.frombuffer(g, np.uint8)[list(f)])] for g in order] for f in order], dtype=np.uint16)
    return np.array([functions[bytes(g)] for g in nxt], dtype=np.uint16), mult.ravel(), np.array([f[FREE] for f in order], dtype=np.uint8)


def _scan(f: np.ndarray, width: int = 64) -> np.ndarray:
    """Products of f[0], f[0] f[1], and so on, by blocks of ``width``."""
    _, mult, _ = _monoid()
    size = int(np.sqrt(len(mult)))
    if len(f) <= width:
        out, acc = np.empty_like(f), 0
        for i, x in enumerate(f.tolist()):
            acc = out[i] = mult[acc * size + x]
        return out
    rows = -(-len(f) // width)
    grid = np.zeros((width, rows), dtype=np.uint16)  # 0: the identity
    padded = np.zeros(rows * width, dtype=np.uint16)
    padded[: len(f)] = f
    grid[:] = padded.reshape(rows, width).T
    for i in range(1, width):
        grid[i] = mult[grid[i - 1].astype(np.int32) * size + grid[i]]
    before = np.concatenate((np.zeros(1, np.uint16), _scan(grid[-1].copy(), width)[:-1]))
    return mult[before.astype(np.int32)[None, :] * size + grid].T.reshape(-1)[: len(f)]


@lru_cache(1)
def _kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    kinds = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    kinds[WHITE_SPACE] = WHITE
    return kinds


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where slices start in texts end to end (each followed by one separator, at ``ends``; separators start slices too)."""
    kinds = _kinds()[points]
    kinds[ends] = END
    white = kinds == WHITE
    ahead = np.zeros(len(kinds), dtype=bool)
    ahead[:-1] = (kinds[1:] != WHITE) & (kinds[1:] != END)
    last = white & ahead
    kinds[last] = BLANK
    kinds[last & (points == 0x20)] = SPACE
    marks = np.flatnonzero((points == 0x27) & (kinds == OTHER))
    if len(marks):
        at = lambda d: points[np.minimum(marks + d, len(points) - 1)]
        inside = lambda d: kinds[np.minimum(marks + d, len(points) - 1)] == LETTER
        for c in CONTRACTIONS:
            same = inside(1) & (at(1) == ord(c[0])) & (inside(2) & (at(2) == ord(c[1])) if len(c) == 2 else True)
            kinds[marks[same]] = LONG if len(c) == 2 else SHORT
    generators, _, from_free = _monoid()
    state = np.zeros(len(kinds), dtype=np.uint8)
    state[1:] = from_free[_scan(generators[kinds])[:-1]]
    return np.flatnonzero(_machine()[1].ravel()[kinds.astype(np.int16) * 8 + state])


class Encoder:
    """Ranks of a rank file, and the cache."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.vocabulary.values()) + 1)
        for token, i in self.vocabulary.items():
            self.bytes_of[i] = token
        self.byte_ids = np.array([self.vocabulary[bytes([b])] for b in range(256)], dtype=np.int64)
        # The vocabulary's bytes end to end, and where each id's lie.
        self.data = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.size = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.place = np.cumsum(self.size) - self.size
        self._pairs()
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def _pairs(self) -> None:
        """An open-addressed table: pair of ids -> the id of what they join to."""
        n = len(self.bytes_of)
        keys, joined = [], []
        for token, i in self.vocabulary.items():
            for cut in range(1, len(token)):
                a, b = self.vocabulary.get(token[:cut]), self.vocabulary.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    joined.append(i)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask, self.n = np.uint64(64 - bits), (1 << bits) - 1, n
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.joined = np.full(1 << bits, 1 << 40, dtype=np.int64)
        left = np.arange(len(keys))
        key, value = np.array(keys, dtype=np.int64), np.array(joined, dtype=np.int64)
        slot = self._slots(key)
        self.probes = 0
        while len(left):
            free = self.keys[slot[left]] < 0
            first = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.keys[slot[first]], self.joined[slot[first]] = key[first], value[first]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & self.mask
            self.probes += 1

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The joined id, which is the pair's rank, or a large number."""
        key = a * self.n + b
        slot = self._slots(key)
        out = np.where(self.keys[slot] == key, self.joined[slot], 1 << 40)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(open_):
            at = slot[open_] = (slot[open_] + 1) & self.mask
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = self.joined[at[hit]]
            open_ = open_[~hit & (self.keys[at] >= 0)]
        return out

    def merge(self, slices: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each slice: all slices' merges of one level at once.

        Ids of slices lie end to end; a pair across two slices has no rank. A slice's best pair is that
        of the smallest (rank, place); pairs that are the best of their slice are joined.
        """
        none = 1 << 40
        found: list[tuple[int, ...]] = [()] * len(slices)
        size = np.array([len(s) for s in slices], dtype=np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(slices), dtype=np.uint8)]
        own = np.repeat(np.arange(len(slices)), size)
        while len(ids):
            rank = np.full(len(ids), none, dtype=np.int64)
            rank[:-1] = self._rank(ids[:-1], ids[1:])
            rank[:-1][own[:-1] != own[1:]] = none
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            best = np.minimum.reduceat(rank, head)
            length = np.diff(np.concatenate((head, [len(ids)])))
            done = best == none
            if done.any():
                flat_ids = ids.tolist()
                for i, a, n in zip(own[head[done]].tolist(), head[done].tolist(), length[done].tolist()):
                    found[i] = tuple(flat_ids[a : a + n])
                if done.all():
                    break
            hits = np.flatnonzero((rank == np.repeat(best, length)) & (rank < none))
            # The leftmost of equal ranks in each slice; others wait for the next round, as a join may take one of their halves.
            hits = hits[np.unique(own[hits], return_index=True)[1]]
            ids[hits] = rank[hits]
            live = np.repeat(~done, length)
            live[hits + 1] = False
            ids, own = ids[live], own[live]
        return found

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of each text."""
        ids, _ = self.encode_slices(texts)
        return ids

    def encode_slices(self, texts: list[bytes]) -> tuple[list[list[int]], list[int]]:
        """Ids of each text, and the number of its slices."""
        joined = b"\n".join(texts) + b"\n"
        points = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        data = np.frombuffer(joined, dtype=np.uint8)
        # Byte offset of each code point.
        place = np.flatnonzero((data & 0xC0) != 0x80)
        text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        ends = np.searchsorted(place, text_ends)
        starts = boundaries(points, ends)
        cuts = place[starts].tolist()
        slices = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
        slices.append(b"\n")
        if len(self.cache) > CACHE_SLICES:
            self.cache.clear()
        cache = self.cache
        missing = list({s for s in slices if s not in cache})
        # Long slices (a run without spaces) are merged apart, as their many rounds would hold up the others.
        short = [s for s in missing if len(s) <= 64]
        cache.update(zip(short, self.merge(short)))
        for s in missing:
            if len(s) > 64:
                cache[s] = self.merge_long(s)
        last = np.searchsorted(starts, ends).tolist()
        out, counts, at = [], [], 0
        for end in last:
            own: list[int] = []
            for s in slices[at:end]:
                own += cache[s]
            out.append(own)
            counts.append(end - at)
            at = end + 1
        for s in missing:
            if len(s) > 4096:
                del cache[s]
        return out, counts

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges for one long slice, with a heap of pairs over a linked list: n log n."""
        import heapq

        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n, none = len(ids), 1 << 40
        ranks = self._rank(np.array(ids[:-1], dtype=np.int64), np.array(ids[1:], dtype=np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < none]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = {}
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n:
                    key = (ids[x], ids[y])
                    if key not in pair:
                        pair[key] = self.vocabulary.get(self.bytes_of[key[0]] + self.bytes_of[key[1]], none)
                    if pair[key] < none:
                        heapq.heappush(heap, (pair[key], x, *key))
        return tuple(i for i in ids if i >= 0)

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0]

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each id starts in the ids' text, and the text's length."""
        out = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(self.size[ids], out=out[1:])
        return out

    def offsets(self, ids: list[int]) -> np.ndarray:
        return self.starts(np.array(ids, dtype=np.int64))

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The texts of ids[at[i]:at[i + 1]]: each id's bytes are taken from where they lie in the vocabulary to the id's offset."""
        out = self.starts(ids)
        size = self.size[ids]
        data = self.data[np.arange(out[-1]) + np.repeat(self.place[ids] - out[:-1], size)].tobytes()
        cuts = out[at].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text's begin."""
    at = np.cumsum([0, *map(len, found)])
    return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(at[-1])), at


def with_ids(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``docs`` without its text, with ``ids`` (array of int) and ``offsets`` (byte offset of each id)."""
    path = path or default_path()
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.LongType()))]

    def make():
        def each(column: pa.Array) -> list[pa.Array]:
            e = encoder(path)
            ids, at = _flat(e.encode([t or b"" for t in column.to_pylist()]))
            starts = e.starts(ids)[:-1]
            own = starts - np.repeat(np.append(starts, 0)[at[:-1]], np.diff(at))
            ends = pa.array(at.astype(np.int32))
            return [pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(own))]

        return each

    return _rows(docs, text, keep, fields, make)


def _rows(docs: DataFrame, text: str, keep: list[str] | None, fields: list[T.StructField], make) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = {f.name.lower() for f in fields}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names and (keep is not None or c != text)]
    row = F.struct(F.lit(True).alias("_"), *[docs[f"`{c}`"] for c in keep]).alias("_row")
    found = row_map(docs.select(row, as_bytes(docs[f"`{text}`"]).alias("_text")), "_text", fields, make, most=1 << 20)
    return found.select(*[F.col("_row").getField(c).alias(c) for c in keep], *[f.name for f in fields])


def round_trip(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``docs`` without its text, with n_tokens, ids_sha256 and decoded_sha256: ids are decoded again, by their offsets, where they are made."""
    path = path or default_path()
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make():
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def each(column: pa.Array) -> list[pa.Array]:
            e = encoder(path)
            ids, at = _flat(e.encode([t or b"" for t in column.to_pylist()]))
            raw = ids.astype("<u4").tobytes()
            cuts = (4 * at).tolist()
            return [long(np.diff(at)), pa.array([sha(raw[a:b]) for a, b in zip(cuts, cuts[1:])]), pa.array([sha(x) for x in e.decode_all(ids, at)])]

        return each

    return _rows(docs, text, keep, fields, make)


def encoded(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``docs`` without its text, with ``ids`` and ``decodes``, whether they come back, by their offsets, to the text's bytes."""
    path = path or default_path()

    def make():
        def each(column: pa.Array) -> list[pa.Array]:
            e = encoder(path)
            texts = [t or b"" for t in column.to_pylist()]
            ids, at = _flat(e.encode(texts))
            return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array([x == t for x, t in zip(e.decode_all(ids, at), texts)], pa.bool_())]

        return each

    return _rows(docs, text, keep, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decodes", T.BooleanType())], make)


def token_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``docs`` without its text, with n_tokens."""
    path = path or default_path()

    def make():
        return lambda column: [long([len(x) for x in encoder(path).encode([t or b"" for t in column.to_pylist()])])]

    return _rows(docs, text, keep, [T.StructField("n_tokens", T.LongType())], make)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), keep=["doc_id"])
