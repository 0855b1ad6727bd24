"""Lines that many documents share, or that come again, found in one sorted stream of line hashes.

Each line becomes two 64-bit hashes of its key (stripped, in lower case), its document and its place; the text
itself isn't moved. The rows are dealt out by ranges of hash and document and sorted by hash, document and place
inside a range, so that equal lines stand together in the order of the corpus, and a range is read once as a
stream: a run of equal hashes is decided as soon as enough documents were seen, and no more of it is held than
that. A line that a large part of all rows has covers several ranges. So the first and the last run of a range
are left open where they aren't decided, of a decided one its first row is held back, and these few rows of all
ranges are settled together. What is to go comes back to its document as one compressed bitmap of places to
keep.

Defined results: a null or empty text is one empty line; a line without a character after stripping has no key
and always stays; documents are told apart by key and text, so repeated rows are one document and get the same bitmap;
rows without a key value come first; texts and lines of any length are read whole; an empty table gives an empty
result; `kept` returns all columns whatever their names.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import as_bytes, bounded_batches, flat, pieces, staged, staging, table

#: What is stripped from both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
#: States of a streamed row: it goes; it stands in a run that a range leaves open; it is the first of a run at a range's end that was decided.
GOES, OPEN, HEAD = 1, 2, 3

_ROW = ["h1", "h2", "doc", "k1", "k2", "at"]


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line, stripped, with A to Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _own(key: Column, text: Column) -> list[Column]:
    """Two hashes by which a document is told."""
    return [F.xxhash64(key, text).alias("k1"), F.xxhash64(F.lit("second"), text, key).alias("k2")]


def line_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = 1) -> DataFrame:
    """h1, h2, doc, k1, k2, at: each line with a key of ``least_chars`` or more."""
    rows = docs.select(docs[f"`{key}`"].alias("doc"), *_own(docs[f"`{key}`"], docs[f"`{text}`"]), F.posexplode(_split(docs[f"`{text}`"])).alias("at", "line"))
    rows = rows.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= least_chars)
    return rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "doc", "k1", "k2", "at")


class _Stream:
    """The runs of one range: gives the rows that go and those that only all ranges together can settle."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.rest: pa.RecordBatch | None = None  # rows of the last run, not decided yet
        self.head: pa.RecordBatch | None = None  # first row of the last run, decided
        self.first = True  # no run has ended yet
        self.before: tuple | None = None  # the last row seen

    def _given(self, rows: pa.RecordBatch, state: int, fresh: np.ndarray | None = None) -> pa.RecordBatch:
        n = rows.num_rows
        fresh = np.zeros(n, dtype=np.int32) if fresh is None else fresh.astype(np.int32)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, state, dtype=np.int32)), pa.array(fresh)], names=[*_ROW, "state", "fresh"])

    def _closed(self, edge: bool) -> Iterator[pa.RecordBatch]:
        """The held first row of a decided run that has ended."""
        if edge or not self.keep_first:
            yield self._given(self.head, HEAD if edge else GOES)
        self.head = None

    def _once(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """Less the rows that equal the one before: those of repeated documents."""
        places = [rows.column(i).to_numpy() for i in (0, 1, 3, 4, 5)]
        if not rows.num_rows:
            return rows
        new = np.ones(rows.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in places])
        new[0] = self.before != tuple(int(x[0]) for x in places)
        self.before = tuple(int(x[-1]) for x in places)
        return rows if new.all() else rows.take(pa.array(np.flatnonzero(new)))

    def add(self, rows: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        """``rows`` after those before; None at the end."""
        last = rows is None
        if not last:
            rows = self._once(rows)
        if self.rest is not None:
            rows = self.rest if last else pa.Table.from_batches([self.rest, rows]).combine_chunks().to_batches()[0]
            self.rest = None
        if rows is None or not rows.num_rows:
            if last and self.head is not None:
                yield from self._closed(True)
            return
        h1, h2, k1, k2 = (rows.column(i).to_numpy() for i in (0, 1, 3, 4))
        n = rows.num_rows
        begins, fresh = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        fresh[1:] = begins[1:] | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        if self.head is not None:
            begins[0] = h1[0] != self.head.column(0)[0].as_py() or h2[0] != self.head.column(1)[0].as_py()
            on = n if not begins.any() else int(np.argmax(begins))
            if on:
                yield self._given(rows.slice(0, on), GOES)
            if on == n:
                if last:
                    yield from self._closed(True)
                return
            yield from self._closed(self.first)
            self.first = False
            rows, begins, fresh, n = rows.slice(on), begins[on:], fresh[on:], n - on
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        docs = np.add.reduceat(fresh.astype(np.int64), starts)
        decided = docs >= self.min_docs
        edge = np.zeros(len(starts), dtype=bool)
        edge[0] = self.first
        if last:
            edge[-1] = True
        elif decided[-1]:
            self.head = rows.slice(int(starts[-1]), 1)
            if ends[-1] - starts[-1] > 1:
                yield self._given(rows.slice(int(starts[-1]) + 1), GOES)
        else:
            self.rest = rows.slice(int(starts[-1]))
        if not last:
            starts, ends, decided, edge = starts[:-1], ends[:-1], decided[:-1], edge[:-1]
        if not len(starts):
            return
        self.first = False
        # Each row's run, up to the last that has ended.
        of = np.repeat(np.arange(len(starts)), ends - starts)
        leads = np.zeros(len(of), dtype=bool)
        leads[starts] = True
        goes = decided[of] & ~(leads & (edge[of] | self.keep_first))
        for state, chosen in ((GOES, goes), (HEAD, decided[of] & leads & edge[of]), (OPEN, ~decided[of] & edge[of])):
            at = np.flatnonzero(chosen)
            if len(at):
                yield self._given(rows.take(pa.array(at)), state, fresh[at])


def dropped(lines: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """k1, k2, at: the places to drop, of the lines of which ``min_docs`` documents or more have one, all or all but the corpus's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(min_docs, keep_first)
        for batch in batches:
            yield from stream.add(batch)
        yield from stream.add(None)

    schema = T.StructType([*lines.select(*_ROW).schema.fields, T.StructField("state", T.IntegerType()), T.StructField("fresh", T.IntegerType())])
    ranges = lines.repartitionByRange("h1", "h2", "doc", "k1", "k2").sortWithinPartitions(*_ROW)
    streamed = staged(ranges.mapInArrow(run, schema), "lines-streamed")
    # A range leaves two runs open at most, each of fewer documents than decide it.
    edges = streamed.where(F.col("state") != GOES)
    place = F.struct("doc", "k1", "k2", "at")
    settled = edges.groupBy("h1", "h2").agg(F.max("state").alias("most"), F.sum("fresh").alias("docs"), F.min(place).alias("first"))
    settled = settled.where((F.col("most") == HEAD) | (F.col("docs") >= min_docs)).select("h1", "h2", "first")
    more = edges.join(settled, ["h1", "h2"])
    if keep_first:
        more = more.where(place != F.col("first"))
    return streamed.where(F.col("state") == GOES).select("k1", "k2", "at").unionAll(more.select("k1", "k2", "at"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, n_lines and the places to drop, become n_lines, n_dropped and the bitmap."""
    for batch in batches:
        n_lines, gone = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        maps = []
        for n, places in zip(n_lines.to_pylist(), gone):
            keep = np.ones(n, dtype=np.uint8)
            if places.values is not None:
                keep[places.values.to_numpy()] = 0
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        counts = pa.array([0 if p.values is None else len(p.values) for p in gone], pa.int64())
        names = [*batch.schema.names[:-1], "n_dropped", "keep"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts, pa.array(maps, pa.binary())], names=names)


def kept_lines(bitmap: bytes, n_lines: int) -> np.ndarray:
    """A boolean for each line from a bitmap."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines, bitorder="little").astype(bool)


def bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 1, keep_first: bool = True, least_chars: int = 1) -> DataFrame:
    """doc, k1, k2, n_lines, n_dropped, keep: a row for each document, where ``keep`` is the compressed bitmap of the lines that stay.

    By default each line stays where the corpus has it first. With ``keep_first`` false, lines that ``min_docs`` documents or
    more have go everywhere.
    """
    gone = dropped(line_rows(docs, text, key, least_chars), min_docs, keep_first).groupBy("k1", "k2").agg(F.collect_list("at").alias("gone"))
    own = docs.select(docs[f"`{key}`"].alias("doc"), *_own(docs[f"`{key}`"], docs[f"`{text}`"]), F.size(_split(docs[f"`{text}`"])).cast("long").alias("n_lines"))
    own = own.groupBy("k1", "k2").agg(F.first("doc").alias("doc"), F.first("n_lines").alias("n_lines"))
    rows = own.join(gone, ["k1", "k2"], "left").select("doc", "k1", "k2", "n_lines", "gone")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType())])
    return rows.mapInArrow(_bitmaps, schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "_text", 8 << 20):
            data, at = flat(part.column(1))
            raw, out = data.tobytes(), []
            for a, b, n, gone, bitmap in zip(at.tolist(), at[1:].tolist(), *(part.column(i).to_pylist() for i in (2, 3, 4))):
                whole = raw[a:b]
                if gone:
                    lines = whole.split(b"\n")
                    whole = b"\n".join([lines[i] for i in np.flatnonzero(kept_lines(bitmap, n)).tolist()])
                out.append(whole)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary()), part.column(2), part.column(3)], names=["_row", "_kept", "n_lines", "n_dropped"])


def kept(docs: DataFrame, maps: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``_row`` (all columns of ``docs`` but the text), ``_kept`` (the lines that stay, as bytes), n_lines, n_dropped: the bitmaps applied; texts move once."""
    bounded_batches(docs.sparkSession)
    rest = docs.select([docs[f"`{c}`"] for c in docs.columns if c != text])
    row = F.struct(F.lit(True).alias("_"), *[docs[f"`{c}`"] for c in rest.columns]).alias("_row")
    rows = docs.select(row, as_bytes(F.coalesce(docs[f"`{text}`"], F.lit(""))).alias("_text"), *_own(docs[f"`{key}`"], docs[f"`{text}`"]))
    joined = rows.join(maps.select("k1", "k2", "n_lines", "n_dropped", "keep"), ["k1", "k2"]).select("_row", "_text", "n_lines", "n_dropped", "keep")
    schema = T.StructType([joined.schema["_row"], T.StructField("_kept", T.BinaryType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_cut, schema)


def apply(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 10, keep_first: bool = False, least_chars: int = 1) -> DataFrame:
    """``docs`` with the text less the lines that go, and n_lines (before), n_dropped."""
    with staging(docs.sparkSession) as result:
        maps = result(bitmaps(docs, text, key, min_docs, keep_first, least_chars), "lines-bitmaps")
    found = kept(docs, maps, text, key)
    columns = [c for c in docs.columns if c == text or c.lower() not in ("n_lines", "n_dropped")]
    return found.select(*[(F.col("_kept").cast("string") if c == text else F.col("_row").getField(c)).alias(c) for c in columns], "n_lines", "n_dropped")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(as_bytes(F.col("text")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, x[i] AS line, trim(translate(x[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
g AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.k = g.k GROUP BY doc_id
"""
