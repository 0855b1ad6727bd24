"""WARC archives through a chunked record table.

Writing. A record's payload becomes rows (record, chunk number, bytes) of at most CHUNK bytes, cut in the
JVM; the rows of a record stay together and in order, as nothing is shuffled between the cut and the
writer. A writer streams them: the header at chunk 0, then bytes, adding each chunk to a running SHA-1
that must come to the digest in the header. No Python process ever holds a whole payload. Every record is
a gzip member of its own, and files are changed at about FILE_BYTES.

Each writing task makes files with names of its own attempt and returns them as rows of a manifest; only
files in the manifest of the attempts that counted are ever read, so lost executors and repeated or
speculative tasks leave no double records. Files are in the folder that all executors share and are
reached by pyarrow's file systems.

Reading. Files of the manifest are dealt to tasks and streamed back into the chunk table, with the running
digest and number of bytes of the record in each row; a record is complete where its last chunk's digest
is that of its header.

Of records with equal payloads of MIN_REVISIT bytes or more, that with the largest page_id is written as
`response`, others as `revisit` (without payload, referring to it).

Defined results: a null payload is empty; rows with the same page_id and payload are all written, and if
theirs is the largest page_id all are responses; a null page_id has no header of its own, is never
referred to, and its record is a revisit if another row with a page_id has the payload; a payload of any
length is written and read in chunks (Spark itself holds the row it comes from); an empty table gives an
empty archive and result; a plan keeps all columns but those it adds, and archives keep page_id and url.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, drop, fresh_path, staged, staging, table, without

CHUNK = 64 << 10
FILE_BYTES = 64 << 20
MIN_REVISIT = 1000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Fixed value: the date of records whose capture time is not known.
NO_DATE = "1970-01-01T00:00:00Z"
#: What a plan adds.
PLANNED = ["payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}') if page_id is not None else uuid.uuid4()}"


def plan(pages: DataFrame, payload: str = "html") -> DataFrame:
    """``pages`` with payload (binary), payload_bytes, payload_digest, record_type and refers_to.

    Digests are added up before the shuffle. Only those that two rows or more have are joined, from a
    written table, so Spark can split a digest that a large part of all rows has.
    """
    rest = without(pages, *PLANNED)
    data = F.coalesce(pages[f"`{payload}`"].cast("binary"), F.lit(b""))
    row = F.struct(*[pages[f"`{c}`"] for c in rest.columns])
    df = pages.select(row.alias("_row"), data.alias("payload"), F.octet_length(data).cast("long").alias("payload_bytes"), F.sha1(data).alias("payload_digest"))
    page = F.col("_row.page_id")
    many = df.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), F.max(page).alias("_first"))
    many = staged(many.where("n > 1 AND _first IS NOT NULL").select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "_first"), "warc-repeated")
    joined = df.join(many, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    again = F.col("_first").isNotNull() & ~page.eqNullSafe(F.col("_first"))
    own = {"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first"))}
    return joined.select(*[F.col("_row").getField(c).alias(c) for c in rest.columns], *PLANNED[:3], *[c.alias(n) for n, c in own.items()])


def chunks(planned: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table: page_id, url, record_type, refers_to, payload_bytes, payload_digest, chunk, last, data."""
    sent = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    n = F.greatest(F.ceil(sent / size).cast("int"), F.lit(1))
    one = planned.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    data = F.when(F.col("record_type") == "response", F.expr(f"substring(payload, chunk * {size} + 1, {size})")).otherwise(F.lit(b""))
    return one.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk", (F.col("chunk") == F.col("n") - 1).alias("last"), data.alias("data"))


def header(row: dict) -> bytes:
    """The record's header block, and the HTTP header of its response."""
    uri = record_uri(row["page_id"])
    clean = lambda s: "".join(c for c in s if c not in "\r\n")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{uri}>",
        f"WARC-Date: {NO_DATE}",
        f"WARC-Target-URI: {clean(row['url'] or uri)}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: <{record_uri(row['refers_to'])}>", f"X-Refers-To-Page-ID: {row['refers_to']}", f"WARC-Profile: {PROFILE}"]
        body = len(http)
    else:
        body = len(http) + row["payload_bytes"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {body}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


class Writer:
    """Streams chunk rows into archive files."""

    def __init__(self, folder: str, file_bytes: int = FILE_BYTES):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.scheme = folder[: len(folder) - len(self.folder)]
        self.file_bytes, self.out, self.path = file_bytes, None, ""
        self.done: list[tuple[str, int, int]] = []

    def add(self, row: dict) -> None:
        if row["chunk"] == 0:
            if self.out is not None and self.at >= self.file_bytes:
                self.close()
            if self.out is None:
                self.path, self.records, self.at = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                self.out = self.fs.open_output_stream(self.path, compression=None)
            self.gz, self.sha = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
            self._put(self.gz.compress(header(row)))
        self.sha.update(row["data"])
        self._put(self.gz.compress(row["data"]))
        if row["last"]:
            if row["record_type"] == "response" and self.sha.hexdigest() != row["payload_digest"]:
                raise ValueError(f"page {row['page_id']}: chunks don't come to the payload's digest")
            self._put(self.gz.compress(b"\r\n\r\n") + self.gz.flush())
            self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.scheme + self.path, self.records, self.at))
            self.out = None


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Archives of all rows in ``folder``; returns the manifest (path, records, bytes), itself a written table."""
    bounded_batches(planned.sparkSession)
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Writer(folder)
        for batch in batches:
            for row in _rows(batch):
                w.add(row)
        w.close()
        if w.done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*w.done)], names=["path", "records", "bytes"])

    return staged(chunks(planned).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for row in zip(*(c.to_pylist() for c in batch.columns)):
        yield dict(zip(names, row))


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a file, each as an iterator of some bytes; read each to its end before the next."""
    held = stream.read(CHUNK)
    while held:
        unzip = zlib.decompressobj(31)

        def inside():
            nonlocal held
            while True:
                more = unzip.decompress(held, CHUNK)
                held = unzip.unconsumed_tail or unzip.unused_data
                if more:
                    yield more
                if unzip.eof:
                    return
                if not held:
                    held = stream.read(CHUNK)
                    if not held:
                        raise EOFError("an archive ends within a record")

        yield inside()
        if not held:
            held = stream.read(CHUNK)


def read_records(stream) -> Iterator[tuple[dict[str, str], int, bytes, str, int, bool]]:
    """headers, chunk number, bytes, SHA-1 of the payload so far, its bytes so far, last: the chunk rows of an archive."""
    for member in _members(stream):
        head = b""
        for some in member:
            head += some
            if head.count(b"\r\n\r\n") >= 2:
                break
        warc, http, rest = head.split(b"\r\n\r\n", 2)
        fields = dict(line.split(": ", 1) for line in warc.decode().split("\r\n")[1:])
        left = int(fields["Content-Length"]) - len(http) - 4
        sha, n, number = hashlib.sha1(), 0, 0
        while True:
            some, rest = rest[:left], b""
            left -= len(some)
            sha.update(some)
            n += len(some)
            if left:
                yield fields, number, some, sha.hexdigest(), n, False
                number += 1
                rest = next(member)
            else:
                yield fields, number, some, sha.hexdigest(), n, True
                break
        for _ in member:
            pass


_READ = "page_id long, url string, record_type string, refers_to long, header_bytes long, header_digest string, chunk int, last boolean, n_bytes long, digest string, data binary"


def read(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in a manifest; without the bytes, only each record's last row is returned."""
    spark = manifest.sparkSession
    bounded_batches(spark)
    # As many partitions as files: the archives are read by as many tasks as there are executors for, and a lost task costs some files.
    files = manifest.select("path").repartition(max(manifest.count(), 1), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _READ.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for h, number, some, digest, n, last in read_records(stream):
                        if not with_data and not last:
                            continue
                        number_of = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        rows.append((number_of("X-Page-ID"), h["WARC-Target-URI"], h["WARC-Type"], number_of("X-Refers-To-Page-ID"), number_of("X-Payload-Length"), h["WARC-Payload-Digest"].removeprefix("sha1:"), number, last, n, digest, some if with_data else None))
                        held += len(some) if with_data else 200
                        if held > 4 << 20 or len(rows) >= 4096:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(run, _READ)


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)


def records(manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's bytes and digest are those of the payload as it was read; reading fails if they differ from its header.
    """
    whole = read(manifest, with_data=False).where("last")
    response = F.col("record_type") == "response"
    same = ~response | ((F.col("digest") == F.col("header_digest")) & (F.col("n_bytes") == F.col("header_bytes")))
    return whole.where(F.assert_true(same, F.lit("an archived payload differs from its header")).isNull()).select(
        "page_id",
        F.when(response, F.col("n_bytes")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = fresh_path(spark, "warc")
    with staging(spark) as result:
        found = result(records(write(plan(pages), folder)), "warc-records")
    drop(spark, folder)
    return found


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
m AS (SELECT html, max(page_id) AS first, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN n > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html
"""
