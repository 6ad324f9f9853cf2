"""Delimited members of zip files of any size: a data source of one partition a member, and a writer.

Planning reads the archives' central directories only.  A task streams its
member through the inflater and a block reader, so neither an archive nor a
member is in memory whole; columns that are not asked for are not converted, and
rows without a wanted key leave inside the reader.
"""

from __future__ import annotations

import gzip
import io
import json
import sys
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Bytes of text that a reader holds at a time, and keys that may travel to it.
BLOCK_BYTES, MOST_KEYS = 1 << 20, 100_000


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """Zip files at a path, which is one, or in the folder that it names."""
    store, where = file_system(path)
    info = store.get_file_info(where)
    if info.type == pyarrow.fs.FileType.File:
        return [where]
    found = store.get_file_info(pyarrow.fs.FileSelector(where))
    return sorted(f.path for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith(".zip"))


@contextmanager
def opened(store: pyarrow.fs.FileSystem, archive: str) -> Iterator[zipfile.ZipFile]:
    """An archive by its central directory; a tiny one, in which the search for that would step before the file's start, from memory."""
    with store.open_input_file(archive) as f, zipfile.ZipFile(io.BytesIO(f.read()) if f.size() < 1 << 16 else f) as z:
        yield z


@dataclass
class Member(InputPartition):
    """A member of an archive; one task reads it."""

    archive: str
    name: str


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.arrow, self.path = to_arrow_schema(schema), options["path"]
        self.suffixes, self.delimiter = tuple(json.loads(options["suffixes"])), options["delimiter"]
        self.names = json.loads(options["names"]) if "names" in options else None
        self.keys = json.loads(options.get("keys", "{}"))

    def partitions(self) -> list[Member]:
        store, out = file_system(self.path)[0], []
        for archive in archives(self.path):
            with opened(store, archive) as z:
                out += [Member(archive, m.filename) for m in z.infolist() if not m.is_dir() and m.filename.endswith(self.suffixes)]
        return out

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no member anywhere
            return
        keys = {c: pa.array(v, pa.string()) for c, v in self.keys.items()}
        kinds = {f.name: f.type for f in self.arrow} | dict.fromkeys(keys, pa.string())
        columns = list(dict.fromkeys([*self.arrow.names, *keys]))
        convert = pa.csv.ConvertOptions(include_columns=columns, column_types=kinds, strings_can_be_null=True, quoted_strings_can_be_null=False)
        with opened(file_system(self.path)[0], partition.archive) as z, z.open(partition.name) as raw:
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if partition.name.endswith(".gz") else raw, BLOCK_BYTES)
            if self.names is None and not stream.peek(1):
                return
            reader = pa.csv.open_csv(stream, pa.csv.ReadOptions(block_size=BLOCK_BYTES, column_names=self.names), pa.csv.ParseOptions(delimiter=self.delimiter, newlines_in_values=True), convert)
            for batch in reader:
                if keys:
                    wanted = [pc.is_in(batch.column(c), value_set=v) for c, v in keys.items()]
                    mask = wanted[0]
                    for more in wanted[1:]:
                        mask = pc.or_(mask, more)
                    batch = batch.filter(mask)
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(c).cast(self.arrow.field(c).type) for c in self.arrow.names], schema=self.arrow)


class ZipMembers(DataSource):
    """Data source "zip_members": options path, suffixes, delimiter, names (of a member without a header), keys."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def zip_table(spark: SparkSession, path: str, schema: str, suffixes: tuple[str, ...] = (".csv", ".csv.gz"), delimiter: str = ",", names: list[str] | None = None, keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of the members whose name ends in one of `suffixes`, of one zip file or of all in a folder; those ending in .gz are unpacked on the way.

    `schema` lists the columns to take.  `names` are the columns of members without
    a header.  With `keys`, a row stays if one of the named columns holds one of its
    keys, as text; more than MOST_KEYS are an error: join instead.  Empty fields
    are null.  Members without rows, and archives without members, give none.
    """
    if sum(map(len, (keys or {}).values())) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: read without keys and join")
    spark.dataSource.register(ZipMembers)
    options = {"path": path, "suffixes": json.dumps(suffixes), "delimiter": delimiter} | ({"names": json.dumps(names)} if names else {}) | ({"keys": json.dumps(keys)} if keys else {})
    return spark.read.format("zip_members").schema(schema).options(**options).load()


def write_zips(df: DataFrame, path: str, rows_of_member: int = 100_000, header: bool = True, delimiter: str = ",") -> int:
    """Write each partition as one zip file of members of so many rows; the number of members.

    Tasks write in blocks to a file of their own and give it its name when it is
    whole, so one that runs again replaces what it has left.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, where = file_system(path)
        store.create_dir(where, recursive=True)
        part = f"{where}/part-{context.partitionId():06d}.zip"
        draft, members, left, out = f"{part}.{context.taskAttemptId()}.draft", 0, 0, None
        with store.open_output_stream(draft) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                while batch.num_rows:
                    if not left:
                        if out:
                            out.close()
                        out, left, members = z.open(f"member-{members:05d}.csv", "w", force_zip64=True), rows_of_member, members + 1
                        if header:
                            out.write((delimiter.join(names) + "\n").encode())
                    pa.csv.write_csv(batch.slice(0, left), out, pa.csv.WriteOptions(include_header=False, delimiter=delimiter, quoting_style="needed"))
                    left, batch = left - min(left, batch.num_rows), batch.slice(min(left, batch.num_rows))
            if out:
                out.close()
        store.move(draft, part)
        yield pa.RecordBatch.from_arrays([pa.array([members], pa.int64())], names=["n"])

    return df.mapInArrow(run, "n long").toPandas()["n"].sum()
