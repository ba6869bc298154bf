"""A source and sink written in Python: Parquet files that count only once a manifest names them.

Tasks write files (first phase); the commit names them, with each column's least and greatest value, in the manifest of
the batch (second phase). A batch that runs again writes its manifest again, so its rows neither go missing nor come
twice; files that no manifest names are never read. A reader gets the columns of its schema as Arrow batches and leaves
out files whose values can't pass the filters; a stream's offset is the number of manifests.

``spark.read.format("ledger").schema(..).option("path", "file:///shared/x")``; likewise ``write``, ``readStream``, ``writeStream``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.sources import shared


@dataclass
class Files(D.WriterCommitMessage):
    files: list[dict]


@dataclass
class File(D.InputPartition):
    name: str


def _manifests(folder: str) -> list[str]:
    store, path = shared.store(folder)
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.startswith("manifest-"))


def _files(folder: str, names: list[str]) -> list[dict]:
    store, path = shared.store(folder)
    out = []
    for name in names:
        with store.open_input_stream(f"{path}/{name}") as f:
            out += json.loads(f.read())
    return out


def _bounds(table: pa.Table) -> dict:
    """Least and greatest value of each column whose values JSON can hold, and whether it has only nulls."""
    import pyarrow.compute as pc

    out = {}
    for name in table.column_names:
        c = table[name]
        if pa.types.is_integer(c.type) or pa.types.is_string(c.type) or pa.types.is_boolean(c.type):
            b = pc.min_max(c)
            out[name] = [b["min"].as_py(), b["max"].as_py()]
    return out


def _may_hold(file: dict, f: D.Filter) -> bool:
    """False only where no row of the file can pass."""
    column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
    if column not in file["bounds"]:
        return True
    low, high = file["bounds"][column]
    if low is None:  # nulls alone, which pass no comparison
        return isinstance(f, (D.IsNull, D.EqualNullSafe, D.Not))
    if isinstance(f, D.EqualTo):
        return low <= f.value <= high
    if isinstance(f, D.In):
        return any(v is not None and low <= v <= high for v in f.value)
    if isinstance(f, D.GreaterThan):
        return high > f.value
    if isinstance(f, D.GreaterThanOrEqual):
        return high >= f.value
    if isinstance(f, D.LessThan):
        return low < f.value
    return low <= f.value if isinstance(f, D.LessThanOrEqual) else True


class _Reads:
    def __init__(self, schema, options):
        self.folder, self.names, self.filters = options["path"], schema.fieldNames(), []

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store, path = shared.store(self.folder)
        with store.open_input_file(f"{path}/{partition.name}") as f:
            yield from pq.ParquetFile(f).iter_batches(10_000, columns=self.names)


class Reader(_Reads, D.DataSourceReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        self.filters = filters
        yield from filters  # a file that may hold rows is still filtered row by row

    def partitions(self) -> list[File]:
        files = _files(self.folder, _manifests(self.folder))
        return [File(f["name"]) for f in files if all(_may_hold(f, x) for x in self.filters)]


class StreamReader(_Reads, D.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"manifests": 0}

    def latestOffset(self) -> dict:
        return {"manifests": len(_manifests(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(f["name"]) for f in _files(self.folder, _manifests(self.folder)[start["manifests"] : end["manifests"]])]


class _Writes:
    def __init__(self, schema, options):
        self.folder, self.schema = options["path"], to_arrow_schema(schema)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        import pyarrow.parquet as pq

        store, path = shared.store(self.folder)
        store.create_dir(path, recursive=True)
        files, out, kept = [], None, {}
        name = f"rows-{uuid.uuid4().hex}.parquet"
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = pq.ParquetWriter(f"{path}/{name}", batch.schema, filesystem=store)
            out.write_batch(batch)
            rows += batch.num_rows
            for c, (low, high) in _bounds(pa.Table.from_batches([batch])).items():
                a, b = kept.get(c, (None, None))
                kept[c] = (low if a is None else a if low is None else min(a, low), high if b is None else b if high is None else max(b, high))
        if out is not None:
            out.close()
            files.append({"name": name, "rows": rows, "bounds": kept})
        return Files(files)

    def _commit(self, messages, number: int) -> None:
        store, path = shared.store(self.folder)
        store.create_dir(path, recursive=True)
        hidden = f"{path}/.{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        store.move(hidden, f"{path}/manifest-{number:012d}.json")

    def _drop(self, messages) -> None:
        store, path = shared.store(self.folder)
        for m in messages:
            for f in m.files if m is not None else []:
                store.delete_file(f"{path}/{f['name']}")


class Writer(_Writes, D.DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self._commit(messages, len(_manifests(self.folder)))

    def abort(self, messages) -> None:
        self._drop(messages)


class StreamWriter(_Writes, D.DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages, batchId: int) -> None:
        self._drop(messages)


class Ledger(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self):
        raise ValueError("give the schema: spark.read.format('ledger').schema(..)")

    def reader(self, schema) -> Reader:
        return Reader(schema, self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(schema, self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Ledger)
