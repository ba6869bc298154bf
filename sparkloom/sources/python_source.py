"""A source written in Python: log lines of ``key=value`` pairs in text files of a folder, which the reader lists and the tasks read line by line."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.sources import shared


class LinesPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class KeyValueReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.folder = [f.name for f in schema.fields], options["path"]

    def partitions(self) -> list[LinesPartition]:
        from pyarrow import fs

        store, path = shared.store(self.folder)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        return [LinesPartition(f.path) for f in found if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: LinesPartition) -> Iterator[tuple]:
        store, _ = shared.store(self.folder)
        with store.open_input_stream(partition.path) as f, io.TextIOWrapper(io.BufferedReader(f), encoding="utf-8") as lines:
            for line in lines:
                pairs = dict(x.split("=", 1) for x in line.split() if "=" in x)
                yield tuple(pairs.get(n) for n in self.names)


class KeyValueSource(DataSource):
    """``spark.read.format("keyvalue").schema("a string, b string").option("path", "file:///folder").load()``"""

    @classmethod
    def name(cls) -> str:
        return "keyvalue"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> KeyValueReader:
        return KeyValueReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeyValueSource)
