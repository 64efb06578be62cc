"""A keyed table as a Python data source whose writes are versions: data files first, then one manifest that names them.

    <path>/data/<uuid>.parquet      files of one bucket of keys each, never changed
    <path>/_versions/<n>.json       the schema, and the files of version n by bucket

A write's tasks write files that no manifest names yet; its commit, on the driver, creates the next manifest, which must not exist. Until
then readers see the version before, and whatever ends a write early, a task, an executor or the driver, leaves at most files that nothing
names. Two writers that start from one version cannot both commit: the second fails and its files go. An upsert reads and writes
the buckets that its keys fall into, and takes the other buckets' files over as they are.

The path is a URI or an absolute path of a store that pyarrow reaches and that all executors share. A manifest is created
whole by a link on local and shared disks; elsewhere by a look and a move, which leaves a moment between the two.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewell.operators import keys

FORMAT, BUCKET, BUCKETS = "versioned", "_bucket", 64


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def versions(path: str) -> list[int]:
    fs, root = _store(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/_versions", allow_not_found=True))
    return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))


def manifest(path: str, version: int | None = None) -> dict:
    """The latest version, or that one: its number, schema, key, number of buckets and files by bucket. Version 0 is an empty table."""
    version = max(versions(path), default=0) if version is None else version
    if not version:
        return {"version": 0, "schema": None, "files": {}}
    fs, root = _store(path)
    with fs.open_input_stream(f"{root}/_versions/{version}.json") as f:
        return json.loads(f.read())


def _create(fs: pyarrow.fs.FileSystem, name: str, body: bytes) -> None:
    """Create a file as a whole, unless it is there."""
    fs.create_dir(posixpath.dirname(name), recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(draft) as f:
        f.write(body)
    try:
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            os.link(draft, name)
            return
        if fs.get_file_info(name).type != pyarrow.fs.FileType.NotFound:
            raise FileExistsError(name)
        fs.move(draft, name)
    finally:
        if fs.get_file_info(draft).type != pyarrow.fs.FileType.NotFound:
            fs.delete_file(draft)


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, files: list[str], schema: StructType):
        self.path, self.files, self.names = path, files, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        return [_File(x) for x in self.files] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.name:
            fs, root = _store(self.path)
            with fs.open_input_file(f"{root}/data/{partition.name}") as f:
                yield from pq.ParquetFile(f).iter_batches(columns=self.names)


@dataclass
class _Written(WriterCommitMessage):
    files: dict[int, list[str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, parent: int, replaces: list[int] | None, schema: str):
        self.path, self.parent, self.replaces, self.schema = path, parent, replaces, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _store(self.path)
        fs.create_dir(f"{root}/data", recursive=True)
        files: dict[int, str] = {}
        open_: dict[int, pq.ParquetWriter] = {}
        try:
            for batch in iterator:
                at = batch.column(batch.schema.get_field_index(BUCKET))
                for b in at.unique().to_pylist():
                    if b not in open_:
                        files[b] = f"{uuid.uuid4().hex}.parquet"
                        open_[b] = pq.ParquetWriter(f"{root}/data/{files[b]}", batch.schema, filesystem=fs)
                    open_[b].write_batch(batch.filter(pc.equal(at, b)))
        except BaseException:
            for w in open_.values():
                w.close()
            self._drop(files.values())
            raise
        for w in open_.values():
            w.close()
        return _Written({b: [x] for b, x in files.items()})

    def _drop(self, names) -> None:
        fs, root = _store(self.path)
        for x in names:
            fs.delete_file(f"{root}/data/{x}")

    def commit(self, messages: list[_Written | None]) -> None:
        held = manifest(self.path, self.parent)
        kept = {} if self.replaces is None else {b: f for b, f in held["files"].items() if int(b) not in self.replaces}
        for m in filter(None, messages):
            for b, names in m.files.items():
                kept.setdefault(str(b), []).extend(names)
        fs, root = _store(self.path)
        body = {"version": self.parent + 1, "schema": self.schema, "files": kept}
        _create(fs, f"{root}/_versions/{self.parent + 1}.json", json.dumps(body).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop(x for m in filter(None, messages) for names in m.files.values() for x in names)


class Versioned(DataSource):
    """Options: path; version (else the latest) and buckets, comma-separated, of a read; parent and replaces of a write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _manifest(self) -> dict:
        at = self.options.get("version")
        return manifest(self.options["path"], int(at) if at else None)

    def schema(self) -> str:
        return self._manifest()["schema"]

    def reader(self, schema: StructType) -> _Reader:
        asked = self.options.get("buckets")
        files = self._manifest()["files"]
        return _Reader(self.options["path"], [x for b, names in sorted(files.items()) for x in names if asked is None or b in asked.split(",")], schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        replaces = self.options.get("replaces")
        return _Writer(self.options["path"], int(self.options["parent"]), None if overwrite else [int(b) for b in (replaces or "").split(",") if b], self.options["ddl"])


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in key)), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The table as of a version, the latest by default; only the files of those buckets where they are named."""
    spark.dataSource.register(Versioned)
    at = manifest(path, version)
    if not at["version"]:
        raise FileNotFoundError(f"no version of a table at {path}")
    reader = spark.read.format(FORMAT).option("path", path).option("version", at["version"])
    return (reader if buckets is None else reader.option("buckets", ",".join(map(str, buckets)))).load().drop(BUCKET)


def upsert(spark: SparkSession, path: str, source: DataFrame, key: list[str], buckets: int = BUCKETS) -> int:  # SK1, SK2, SK11
    """Replace rows by key, append the others, as the next version, and give its number. Blank or repeated keys, and another writer's
    version in between, are errors that leave the table as it was. The first version takes the source's columns."""
    spark.dataSource.register(Versioned)
    parent = manifest(path)
    placed = source.withColumn(BUCKET, _bucket(key, buckets))
    touched = sorted(r[BUCKET] for r in placed.select(BUCKET).distinct().collect())  # `buckets` at most
    if parent["version"]:
        current = spark.read.format(FORMAT).option("path", path).option("version", parent["version"]).option("buckets", ",".join(map(str, touched))).load()
    else:
        current = spark.createDataFrame([], placed.schema)
    merged = keys.merge(current, placed, key)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema)
    out = merged.repartition(max(1, len(touched)), BUCKET).write.format(FORMAT).option("path", path).option("parent", parent["version"]).option("ddl", ddl)
    out.option("replaces", ",".join(map(str, touched))).mode("append").save()
    return parent["version"] + 1
