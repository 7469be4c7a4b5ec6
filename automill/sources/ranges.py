"""Files by ranges of bytes, as a Spark data source: neither a file nor a row is bounded by what a task or a row can hold.

``spark.read.format("byte_ranges").option("range", n).option("overlap", k).load(path)`` has a row for each range, with its bytes and up to
``overlap`` bytes before it, so that matches that began there are seen. A task reads a range, or a run of them where there are more than ``TASKS``.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: own is where the range begins, base where the payload does; first says that the payload begins the stream.
SCHEMA = "stream_id string, own bigint, base bigint, first boolean, payload binary"
#: Tasks up to which each range is one; beyond, tasks take runs of ranges of about so many bytes, so their number follows the files' size.
TASKS, TASK_BYTES = 256, 8 << 20


class _Ranges(InputPartition):
    """The ranges of a file that begin from own on, before end."""

    def __init__(self, path: str, own: int, end: int):
        super().__init__((path, own))
        self.path, self.own, self.end = path, own, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = re.sub("^file:/+", "/", options["path"])
        self.step, self.overlap = int(options.get("range", 64 << 20)), int(options.get("overlap", 0))
        if self.step < 1 or self.overlap < 0:
            raise ValueError("range is at least 1 and overlap at least 0")
        found = glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)
        self.paths = sorted(p for p in found if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))
        if not self.paths:
            raise FileNotFoundError(f"no such file: {path}")

    def partitions(self) -> list[_Ranges]:
        sizes = [(path, os.path.getsize(path)) for path in self.paths]
        ranges, bytes_ = sum(-(-size // self.step) for _, size in sizes), sum(size for _, size in sizes)
        run = -(-ranges // max(TASKS, bytes_ // TASK_BYTES)) * self.step or self.step
        return [_Ranges(path, own, min(own + run, size)) for path, size in sizes for own in range(0, size, run)]

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for own in range(partition.own, partition.end, self.step):
                base = max(0, own - self.overlap)
                f.seek(base)
                yield partition.path, own, base, base == 0, f.read(min(own + self.step, partition.end) - base)


class RangeSource(DataSource):
    """Options range and overlap, in bytes. For paths that every executor can open; files that Spark or a user hides (_x, .x) are left out."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RangeSource)
