"""Benchmark decontamination with a generalised suffix automaton.

The items' words, normalised, go into one suffix automaton. Each document's words are streamed through
it: after each word the automaton's state and length give the longest suffix that occurs in some item.
Where that length reaches WINDOW, the last WINDOW words are a window of an item; the state that stands
for those WINDOW words tells which items. Items of fewer words are one window each and are recognised
by the marks their states leave on the suffix links.

The automaton is sent to all executors in blocks of at most ``block_words`` item words, so that what is sent at
once has a bound; a longer item is cut into pieces that share all but one of a window's words. With one block all is done in one pass without a shuffle. A larger
benchmark is checked block after block; each pass reads the texts and writes only the hits, which are few, and
the hits of all blocks are joined to the documents by two hashes of the row.

Defined results: a null or blank text has no words; a null or blank item has no window; items with equal
texts are all reported, rows with equal item numbers once, and items without a number as one with an empty
name; repeated rows are each judged; a text of any length is read whole; with no items nothing is
contaminated; an empty table gives an empty result; input columns named like an output column are replaced,
and `keep` returns all columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import LOWER_ALNUM, as_bytes, bounded_batches, packed, pieces, row_map, staged, table, unpacked

WINDOW = 10
#: Item words in one block: an automaton of at most twice as many states, some 200 MB.
BLOCK_WORDS = 200_000


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers, with what it says of windows."""

    window: int = WINDOW
    words: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: state -> the state of its last ``window`` words; -1 if it has fewer.
    ends: list[int] = field(default_factory=list)
    #: state -> lengths of the short items that end wherever the state does, with their items.
    short: list[tuple[tuple[int, int], ...]] = field(default_factory=list)
    #: (state, length) of a window -> the item numbers that have it.
    items: dict[tuple[int, int], list[int]] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def add(self, name: str, text: bytes) -> None:
        own = [self.words.setdefault(w, len(self.words)) for w in normalised(text)]
        if own:
            self.names.append(name)
            self._todo.append(own)
            last = 0
            for w in own:
                last = self._extend(last, w)

    def __post_init__(self) -> None:
        self._todo: list[list[int]] = []

    def finish(self) -> Automaton:
        """Mark the windows, once all items are in."""
        k = self.window
        marks: dict[int, dict[int, list[int]]] = {}
        for item, own in enumerate(self._todo):
            state = n = 0
            for i, w in enumerate(own):
                state, n = self.next[state][w], n + 1
                if i >= k - 1:
                    state, n = self._shortened(state, k)
                    held = self.items.setdefault((state, k), [])
                    if not held or held[-1] != item:
                        held.append(item)
            if len(own) < k:
                marks.setdefault(state, {}).setdefault(len(own), []).append(item)
        for state, lengths in marks.items():
            for n, held in lengths.items():
                self.items[state, n] = held
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.ends = [-1] * len(order)
        self.short = [()] * len(order)
        for s in order:
            up = self.link[s]
            if self.length[s] >= k:
                self.ends[s] = self.ends[up] if up >= 0 and self.ends[up] >= 0 else s
            own = tuple((n, s) for n in sorted(marks.get(s, ())))
            self.short[s] = (self.short[up] if up >= 0 else ()) + own
        del self._todo
        return self

    def _shortened(self, state: int, k: int) -> tuple[int, int]:
        """The state of the last k words of a match that has k words at least."""
        while self.length[self.link[state]] >= k:
            state = self.link[state]
        return state, k

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (first word, one past the last) of windows that occur among the words, joined where they meet or overlap; the items."""
        nxt, link, length, ends, short, k = self.next, self.link, self.length, self.ends, self.short, self.window
        spans: list[tuple[int, int]] = []
        found: set[tuple[int, int]] = set()
        state = n = 0
        for i, w in enumerate(map(self.words.get, own)):
            if w is None:
                state = n = 0
                continue
            to = nxt[state].get(w)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = nxt[state].get(w)
                n = length[state] if to is not None else 0
                if to is None:
                    continue
            state = to
            n += 1
            widest = 0
            if n >= k:
                found.add((ends[state], k))
                widest = k
            for m, s in short[state]:
                if m <= n:
                    found.add((s, m))
                    widest = max(widest, m)
            if widest:
                a = i + 1 - widest
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, {item for key in found for item in self.items[key]}


def normalised(text: bytes | None) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, A to Z lower-cased."""
    return (text or b"").translate(LOWER_ALNUM).split()


def blocks(items: DataFrame, key: str, text: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[tuple[Automaton, bool]]:
    """Automata of at most ``block_words`` item words each, and whether each is the last; the items come to the driver one partition at a time.

    A longer item goes in as pieces that share ``window`` - 1 words, so that each of its windows is whole in one of them.
    """
    most = max(block_words, window)
    held, n = Automaton(window), 0
    for row in items.select(F.col(f"`{key}`").cast("string"), as_bytes(F.col(f"`{text}`"))).toLocalIterator():
        own = normalised(row[1])
        for start in range(0, max(1, len(own) - window + 1), most - window + 1):
            piece = own[start : start + most]
            if n and piece and n + len(piece) > block_words:
                yield held.finish(), False
                held, n = Automaton(window), 0
            held.add(row[0] if row[0] is not None else "", b" ".join(piece))
            n += len(piece)
    yield held.finish(), True


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_TYPES = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _judged(df: DataFrame, sent, with_text: bool = False, hit_only: bool = False) -> DataFrame:
    """The columns of ``df`` but ``_text``, with FIELDS by one automaton (and ``_text``); only rows that are hit, if ``hit_only``."""
    keep = [c for c in df.columns if c != "_text"]
    schema = T.StructType([df.schema[c] for c in keep] + FIELDS + ([df.schema["_text"]] if with_text else []))
    df = df.select([df[f"`{c}`"] for c in keep] + [df["_text"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        for batch in batches:
            for part in pieces(batch, "_text"):
                counts, spans, items = [], [], []
                for raw in part.column(len(keep)).to_pylist():
                    own = normalised(raw)
                    counts.append(len(own))
                    at, found = a.scan(own)
                    spans.append([list(x) for x in at])
                    items.append(sorted({a.names[i] for i in found}))
                columns = [part.column(i) for i in range(len(keep))] + [pa.array(v, t) for v, t in zip((counts, spans, items), _TYPES)] + ([part.column(len(keep))] if with_text else [])
                out = pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
                yield out.filter(pa.array([bool(x) for x in spans])) if hit_only else out

    return df.mapInArrow(run, schema)


def merged_spans(spans: Column) -> Column:
    """Spans [a, b] of several passes, joined where they meet or overlap."""
    none = F.array().cast("array<array<bigint>>")
    last = lambda held: F.element_at(held, -1)
    joined = lambda held, x: F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.array(last(held)[0], F.greatest(last(held)[1], x[1]))))
    return F.aggregate(F.array_sort(spans), none, lambda held, x: F.when((F.size(held) > 0) & (x[0] <= F.try_element_at(held, F.lit(-1))[1]), joined(held, x)).otherwise(F.concat(held, F.array(x))))


def _all_hits(rows: DataFrame, first: Automaton, more: Iterator[tuple[Automaton, bool]]) -> DataFrame:
    """_k1, _k2, spans, items of the rows (with _k1, _k2, _text) that some block hits: each automaton is dropped before the next is built."""
    sc, found, one = rows.sparkSession.sparkContext, [], first
    while one is not None:
        sent = sc.broadcast(one)
        del one
        found.append(staged(_judged(rows.select("_k1", "_k2", "_text"), sent, hit_only=True).select("_k1", "_k2", "spans", "items"), "decontaminate-hits"))
        sent.destroy()
        one, _ = next(more, (None, True))
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    by = every.groupBy("_k1", "_k2").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return staged(by.select("_k1", "_k2", merged_spans(F.col("spans")).alias("spans"), "items"), "decontaminate-hits")


def _keys(*columns: Column) -> list[Column]:
    return [F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit("second"), *reversed(columns)).alias("_k2")]


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``keep`` (default: all columns but the text) with n_words, spans and items of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    added = [f.name for f in FIELDS]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added and (keep is not None or c != text)]
    row = F.struct(F.lit(True).alias("_"), *[docs[f"`{c}`"] for c in keep]).alias("_row")
    raw = docs[f"`{text}`"]
    df = docs.select(row, as_bytes(raw).alias("_text"))
    built = blocks(items, item_key, item_text, block_words=block_words)
    first, only = next(built)
    if only:
        found = _judged(df, spark.sparkContext.broadcast(first))
    else:
        # Equal texts have equal hits, so the text's hashes do for a key.
        df = docs.select(row, as_bytes(raw).alias("_text"), *_keys(raw))
        hit = _all_hits(df, first, built)
        counts = row_map(df, "_text", [FIELDS[0]], lambda: lambda c: [pa.array([len(normalised(t)) for t in c.to_pylist()], pa.int64())])
        joined = counts.join(hit, ["_k1", "_k2"], "left")
        found = joined.select("_row", "n_words", *[F.coalesce(c, F.array().cast(f.dataType)).alias(c) for c, f in zip(added[1:], FIELDS[1:])])
    return found.select(*[F.col("_row").getField(c).alias(c) for c in keep], *added)


def cut(text: bytes, scan, max_hit: int, max_share: float) -> bytes | None:
    """``text`` without its hit spans of over ``max_hit`` words; None if over ``max_share`` of its words are hit.

    What remains is scanned again until nothing is left to cut, as a cut brings words together.
    """
    first = True
    while True:
        bounds = words_at(text)
        spans = _joined(scan(text))
        if first and sum(b - a for a, b in spans) > max_share * len(bounds):
            return None
        first = False
        spans = [(a, b) for a, b in spans if b - a > max_hit]
        if not spans:
            return text
        text = without_spans(text, spans)


def words_at(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the normalised words."""
    is_word = np.frombuffer(text.translate(LOWER_ALNUM), dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([0], is_word.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without spans of its normalised words."""
    bounds, out, at = words_at(text), [], 0
    for a, b in spans:
        out.append(text[at : bounds[a][0]])
        at = bounds[b - 1][1]
    return b"".join([*out, text[at:]])


def keep(docs: DataFrame, items: DataFrame, max_hit: int = 0, max_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without hit spans of over ``max_hit`` words, and without documents of which over ``max_share`` is hit; n_chars follows the text.

    With one block of items all is done in one pass. With more, all blocks' hits of a document are known
    before it is cut, and what was cut (only that) is scanned again until nothing is left to cut.
    """
    built = blocks(items, "item_id", "text", block_words=block_words)
    first, only = next(built)
    if only:
        return _kept_by_one(docs, first, max_hit, max_share)
    bounded_batches(docs.sparkSession)
    text = F.col("text")
    row = packed(docs, as_bytes(text).alias("_text"), F.lit(False).alias("_cut"), *_keys(text))
    done, turn = [], 0
    while True:
        found = _all_hits(row, first, built).withColumn("_long", F.filter("spans", lambda x: x[1] - x[0] > max_hit))
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
        found = found.select("_k1", "_k2", "_long", (n_hit if turn == 0 else F.lit(0)).alias("_n")).where("_n > 0 OR size(_long) > 0")
        done.append(row.join(found.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti").select("_row", "_text", "_cut"))
        again = staged(_shortened(row.join(found, ["_k1", "_k2"]).select("_row", "_text", "_cut", "_n", "_long"), max_share), "decontaminate-cut")
        done.append(again.where("NOT _again").select("_row", "_text", "_cut"))
        row = again.where("_again").select("_row", "_text", "_cut", *_keys(F.col("_text")))
        if row.isEmpty():
            break
        built = blocks(items, "item_id", "text", block_words=block_words)
        first, turn = next(built)[0], turn + 1
    every = done[0]
    for df in done[1:]:
        every = every.unionByName(df)
    return _restored(every, docs, F.when(F.col("_cut"), F.col("_text").cast("string")).otherwise(F.col("_row.text")))


def _shortened(df: DataFrame, max_share: float) -> DataFrame:
    """Rows with their ``_long`` spans cut out; those that are mostly hit are left out. ``_again``: what was cut has to be scanned again."""
    schema = T.StructType([df.schema[c] for c in ("_row", "_text", "_cut")] + [T.StructField("_again", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.select(["_row", "_cut", "_n", "_long", "_text"]), "_text"):
                texts, longs = part.column(4).to_pylist(), part.column(3).to_pylist()
                keep = [n <= max_share * len(normalised(t)) for n, t in zip(part.column(2).to_pylist(), texts)]
                new = [without_spans(t, [tuple(x) for x in s]) if s else t for t, s in zip(texts, longs)]
                was = [c or bool(s) for c, s in zip(part.column(1).to_pylist(), longs)]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.binary()), pa.array(was), pa.array([bool(s) for s in longs])], names=schema.fieldNames())
                yield out.filter(pa.array(keep))

    return df.mapInArrow(run, schema)


def _restored(df: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The documents' columns of ``_row``, with the new text, and n_chars of those that are ``_cut``."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_cut"), F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return unpacked(df, docs.columns, **new)


def _kept_by_one(docs: DataFrame, automaton: Automaton, max_hit: int, max_share: float) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(automaton)

    def each(column: pa.Array) -> list[pa.Array]:
        scan = lambda text: sent.value.scan(normalised(text))[0]
        old = column.to_pylist()
        new = [None if raw is None else cut(raw, scan, max_hit, max_share) for raw in old]
        changed = [a != b for a, b in zip(old, new)]
        return [pa.array([b if c else None for b, c in zip(new, changed)], pa.binary()), pa.array([a is not None and b is None for a, b in zip(old, new)]), pa.array(changed)]

    fields = [T.StructField("_new", T.BinaryType()), T.StructField("_gone", T.BooleanType()), T.StructField("_cut", T.BooleanType())]
    out = row_map(packed(docs, as_bytes(F.col("text")).alias("_text")), "_text", fields, lambda: each).where("NOT _gone")
    return _restored(out, docs, F.when(F.col("_cut"), F.col("_new").cast("string")).otherwise(F.col("_row.text")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT item_id, 10 AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM iw WHERE len(w) >= 10)
  UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM iw WHERE len(w) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, dg.n FROM dg JOIN win ON dg.k = win.k AND dg.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
