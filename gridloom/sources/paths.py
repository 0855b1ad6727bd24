"""Files through Hadoop's file systems, so that every store Spark reaches is reached."""

from __future__ import annotations

import atexit
import hashlib
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache, wraps
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Location:
    """A path in some file system."""

    path: str
    spark: SparkSession | None = None

    def __str__(self) -> str:
        return self.path

    def __truediv__(self, other: str) -> Location:
        return Location(other if "://" in other or other.startswith("/") else f"{self.path.rstrip('/')}/{other}", self.spark)

    @property
    def protocol(self) -> str:
        return self.path.split("://", 1)[0] if "://" in self.path else "file"

    @property
    def is_remote(self) -> bool:
        return self.protocol != "file"

    @property
    def is_absolute(self) -> bool:
        return "://" in self.path or self.path.startswith("/")

    def without_protocol(self) -> str:
        return self.path.split("://", 1)[-1]

    def with_protocol(self, protocol: str) -> Location:
        return Location(f"{protocol}://{self.without_protocol()}", self.spark)

    @property
    def name(self) -> str:
        return PurePosixPath(self.path).name

    @property
    def stem(self) -> str:
        return PurePosixPath(self.path).stem

    @property
    def suffix(self) -> str:
        return PurePosixPath(self.path).suffix

    @property
    def parent(self) -> Location:
        return Location(self.path.rstrip("/").rpartition("/")[0], self.spark)

    def with_suffix(self, suffix: str) -> Location:
        return self.parent / (self.stem + "." + suffix.lstrip("."))

    def without_suffix(self) -> Location:
        return self.parent / self.stem

    def absolute(self, base: str) -> Location:
        return self if self.is_absolute else Location(base, self.spark) / self.path

    def relative_to(self, base: str) -> str:
        base = base.rstrip("/") + "/"
        return self.path[len(base) :] if self.path.startswith(base) else self.path

    def crop(self, elements: int) -> str:
        """The last path elements."""
        return "/".join(self.path.rstrip("/").split("/")[-elements:])

    def as_vsi(self) -> str:
        """As GDAL names it."""
        known = {"s3": "/vsis3/", "gs": "/vsigs/", "az": "/vsiaz/", "http": "/vsicurl/", "https": "/vsicurl/"}
        if self.protocol in ("http", "https"):
            return known[self.protocol] + self.path
        return known[self.protocol] + self.without_protocol() if self.protocol in known else self.without_protocol()

    # File system

    def _fs(self):
        spark = self.spark or SparkSession.getActiveSession()
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path, spark

    def exists(self) -> bool:
        fs, path, _ = self._fs()
        return fs.exists(path)

    def is_directory(self) -> bool:
        fs, path, _ = self._fs()
        return fs.exists(path) and fs.getFileStatus(path).isDirectory()

    def size(self) -> int:
        fs, path, _ = self._fs()
        return fs.getContentSummary(path).getLength()

    def last_modified(self) -> int:
        fs, path, _ = self._fs()
        return fs.getFileStatus(path).getModificationTime()

    def ls(self) -> list[Location]:
        fs, path, spark = self._fs()
        return sorted((Location(str(s.getPath()), spark) for s in fs.listStatus(path)), key=lambda x: x.path)

    def walk(self) -> Iterator[Location]:
        for x in self.ls():
            if x.is_directory():
                yield from x.walk()
            else:
                yield x

    def paginate(self, size: int = 1000) -> Iterator[list[Location]]:
        page: list[Location] = []
        for x in self.walk():
            page.append(x)
            if len(page) == size:
                yield page
                page = []
        if page:
            yield page

    def makedirs(self) -> None:
        fs, path, _ = self._fs()
        fs.mkdirs(path)

    def rm(self, recursive: bool = False) -> bool:
        fs, path, _ = self._fs()
        return fs.delete(path, recursive)

    def cp(self, target: Location | str, overwrite: bool = False) -> None:
        target = target if isinstance(target, Location) else Location(target, self.spark)
        if target.exists() and not overwrite:
            raise FileExistsError(target.path)
        fs, path, spark = self._fs()
        other, to, _ = target._fs()
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, other, to, False, overwrite, spark._jsc.hadoopConfiguration())

    def read_bytes(self) -> bytes:
        fs, path, spark = self._fs()
        stream = fs.open(path)
        try:
            return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, data: bytes) -> None:
        fs, path, _ = self._fs()
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def read_text(self) -> str:
        return self.read_bytes().decode()

    def write_text(self, text: str) -> None:
        self.write_bytes(text.encode())

    def read_json(self) -> dict:
        return json.loads(self.read_text())

    def write_json(self, value) -> None:
        self.write_text(json.dumps(value, indent=2, sort_keys=True))

    def read_yaml(self) -> dict:
        import yaml

        return yaml.safe_load(self.read_text())

    def write_yaml(self, value) -> None:
        import yaml

        self.write_text(yaml.safe_dump(value))

    def checksum(self) -> str:
        return hashlib.sha256(self.read_bytes()).hexdigest()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for intermediate files that all executors reach: in ``spark.checkpoint.dir``, else in a folder of this
    machine if Spark runs on it alone, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = f"file://{_own_folder()}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_gridloom"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a `work_path` and read again: it is made once, and no plan that follows has it within."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of stored tables that are still there.
_stored: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end: for code whose results are written by then."""
    mark = len(_stored)
    try:
        yield
    finally:
        while len(_stored) > mark:
            Location(_stored.pop(), spark).rm(True)


def tidy(f):
    """A function of a session that leaves no stored tables behind."""

    @wraps(f)
    def run(spark: SparkSession, *args, **more):
        with scratch(spark):
            return f(spark, *args, **more)

    return run


@lru_cache(1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def listing(spark: SparkSession, path: str, pattern: str = "*", checksums: bool = False) -> DataFrame:
    """path, modified, length (and sha256) of files under a folder, listed by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    cols = ["path", F.col("modificationTime").alias("modified"), "length"]
    return files.select(*cols, *([F.sha2("content", 256).alias("sha256")] if checksums else []))


def copied(names: DataFrame, source: str, target: str) -> DataFrame:
    """name and bytes of files that tasks copy from one folder to another, as streams, when this is run; each appears when it is whole."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        from gridloom.sources.sinks import file_system, put_in_place

        for batch in batches:
            sizes = []
            for name in batch.column(0).to_pylist():
                (a, x), (b, y) = file_system(f"{source.rstrip('/')}/{name}"), file_system(f"{target.rstrip('/')}/{name}")
                b.create_dir(y.rpartition("/")[0], recursive=True)
                n, part = 0, f"{y}.{uuid.uuid4().hex}.part"
                with a.open_input_stream(x, compression=None) as stream, b.open_output_stream(part, compression=None) as out:
                    while data := stream.read(8 << 20):
                        out.write(data)
                        n += len(data)
                put_in_place(b, part, y)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return stored(names.select("name").mapInArrow(run, "name string, bytes long"), "copied")


def stem(path):
    """The file's name without folder and suffix, as a column."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def suffix(path):
    return F.regexp_extract(F.substring_index(path, "/", -1), r"(\.[^.]*)$", 1)


def parent(path):
    return F.regexp_replace(path, r"/[^/]*$", "")


def expand_env(text: str, env: dict[str, str]) -> str:
    """``${NAME}`` replaced; an unknown name raises."""

    def put(m: re.Match) -> str:
        if m[1] not in env:
            raise KeyError(f"environment variable {m[1]} isn't set")
        return env[m[1]]

    return re.sub(r"\$\{(\w+)\}", put, text)


def pretty_bytes(n: float) -> str:
    for unit in ("bytes", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024 or unit == "TiB":
            return f"{n:.0f} {unit}" if unit == "bytes" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def pretty_seconds(s: float) -> str:
    minutes, seconds = divmod(s, 60)
    hours, minutes = divmod(int(minutes), 60)
    return f"{hours}h {minutes}m {seconds:.0f}s" if hours else f"{minutes}m {seconds:.0f}s" if minutes else f"{seconds:.3f}s"
