"""Arrow (feather) files as a data source that splits files by record batch.

    register(spark)
    df.write.format("arrowfiles").mode("append").save(folder)
    spark.read.format("arrowfiles").schema("id long, x double").load(folder)

Reading: a task takes a range of record batches of one file, of about ``task_bytes`` together, so one
large file is read by many tasks, and no file is held whole. Only the columns of the schema given are
read from storage (all, if none is given), matched by name and cast to its types; a column that a file
lacks is an error.

Writing: each task attempt writes files under a name of its own and reports them; the commit lists
those of the attempts that count in a manifest. Readers of a folder that has manifests read only listed
files, so files of failed or repeated attempts are never seen. ``overwrite`` replaces what earlier
manifests list. Folders without a manifest are read by their file names.

Addresses are local paths or addresses of any file system pyarrow knows; all executors must reach them.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

TASK_BYTES = 32 << 20
FILE_BYTES = 256 << 20
SUFFIXES = (".arrow", ".feather")
MANIFESTS = "_manifest"


def open_path(address: str) -> tuple[pafs.FileSystem, str]:
    if address.startswith("file:") and not address.startswith("file://"):
        address = "file://" + address[len("file:") :]
    if "://" in address:
        return pafs.FileSystem.from_uri(address)
    return pafs.LocalFileSystem(), os.path.abspath(address)


def _manifests(fs: pafs.FileSystem, folder: str) -> list[tuple[str, dict]]:
    found = fs.get_file_info(pafs.FileSelector(f"{folder}/{MANIFESTS}", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda f: f.path):
        if info.path.endswith(".json"):
            with fs.open_input_file(info.path) as f:
                out.append((info.path, json.loads(f.read())))
    return out


def _open(fs: pafs.FileSystem, path: str, fields: list[int] | None = None) -> pa.ipc.RecordBatchFileReader:
    return pa.ipc.open_file(fs.open_input_file(path), options=pa.ipc.IpcReadOptions(included_fields=fields))


def _files(fs: pafs.FileSystem, path: str) -> list[dict]:
    """name, bytes and, where a manifest tells it, batches of the files to read."""
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [{"path": path, "bytes": info.size}]
    listed = _manifests(fs, path)
    if listed:
        return [{"path": f"{path}/{f['name']}", **f} for _, m in listed for f in m["files"]]
    found = fs.get_file_info(pafs.FileSelector(path))
    return [{"path": f.path, "bytes": f.size} for f in sorted(found, key=lambda f: f.path) if f.path.endswith(SUFFIXES)]


@dataclass
class BatchRange(InputPartition):
    path: str
    first: int
    last: int


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrowfiles"

    def schema(self) -> StructType:
        fs, path = open_path(self.options["path"])
        for _, manifest in _manifests(fs, path):
            return from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(base64.b64decode(manifest["schema"]))))
        for f in _files(fs, path):
            return from_arrow_schema(_open(fs, f["path"]).schema)
        raise ValueError(f"no Arrow files in {path}")

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowFileReader(self.options["path"], schema, int(self.options.get("task_bytes", TASK_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrowFileWriter(self.options["path"], schema, overwrite, int(self.options.get("file_bytes", FILE_BYTES)))


class ArrowFileReader(DataSourceReader):
    def __init__(self, address: str, schema: StructType, task_bytes: int):
        self.address, self.schema, self.task_bytes = address, schema, task_bytes

    def partitions(self) -> list[InputPartition]:
        fs, path = open_path(self.address)
        out: list[InputPartition] = []
        for f in _files(fs, path):
            batches = f["batches"] if "batches" in f else _open(fs, f["path"]).num_record_batches
            step = max(1, batches * self.task_bytes // max(f["bytes"], 1))
            out += [BatchRange(f["path"], lo, min(lo + step, batches)) for lo in range(0, batches, step)]
        return out or [BatchRange("", 0, 0)]

    def read(self, partition: BatchRange) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        fs = open_path(self.address)[0]
        wanted = to_arrow_schema(self.schema)
        stored = _open(fs, partition.path).schema
        places = [stored.get_field_index(n) for n in wanted.names]
        if min(places, default=0) < 0:
            raise ValueError(f"{partition.path} has no column {wanted.names[places.index(-1)]!r}")
        reader = _open(fs, partition.path, sorted(places) or None)
        for i in range(partition.first, partition.last):
            batch = reader.get_batch(i)
            columns = [batch.column(n).cast(t.type) if batch.column(n).type != t.type else batch.column(n) for n, t in zip(wanted.names, wanted)]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted)


@dataclass
class Written(WriterCommitMessage):
    files: list


class ArrowFileWriter(DataSourceArrowWriter):
    def __init__(self, address: str, schema: StructType, overwrite: bool, file_bytes: int):
        self.address, self.overwrite, self.file_bytes = address, overwrite, file_bytes
        self.schema = base64.b64encode(to_arrow_schema(schema).serialize().to_pybytes()).decode()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = open_path(self.address)
        done: list[dict] = []
        writer = out = None
        for batch in iterator:
            if writer is None:
                fs.create_dir(folder, recursive=True)
                name = f"part-{uuid.uuid4().hex}.arrow"
                out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                writer = pa.ipc.new_file(out, batch.schema)
                done.append({"name": name, "batches": 0, "rows": 0, "bytes": 0})
            writer.write_batch(batch)
            done[-1]["batches"] += 1
            done[-1]["rows"] += batch.num_rows
            done[-1]["bytes"] = out.tell()
            if out.tell() >= self.file_bytes:
                writer.close()
                out.close()
                writer = None
        if writer is not None:
            writer.close()
            out.close()
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, folder = open_path(self.address)
        fs.create_dir(f"{folder}/{MANIFESTS}", recursive=True)
        old = _manifests(fs, folder)
        listing = {"schema": self.schema, "files": [f for m in messages if m is not None for f in m.files]}
        path = f"{folder}/{MANIFESTS}/{len(old):06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{path}.tmp", compression=None) as out:
            out.write(json.dumps(listing).encode())
        fs.move(f"{path}.tmp", f"{path}.json")
        if self.overwrite:
            for manifest, content in old:
                fs.delete_file(manifest)
                for f in content["files"]:
                    fs.delete_file(f"{folder}/{f['name']}")

    def abort(self, messages: list) -> None:
        """Files that no manifest lists are never read."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowFiles)
