"""Growing text files as a stream: a data source that goes on from byte offsets."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: How much of a file's end is searched for the last line end at a time, and read at a time.
BLOCK = 1 << 16


def _complete(path: str) -> int:
    """The number of bytes up to the last line end."""
    end = os.path.getsize(path)
    with open(path, "rb") as f:
        while end > 0:
            start = max(0, end - BLOCK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str):
        self.folder, self.pattern = folder.removeprefix("file://"), pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if not os.path.isdir(self.folder):
            return {}
        found = sorted(f for f in os.listdir(self.folder) if fnmatch.fnmatch(f, self.pattern) and os.path.isfile(os.path.join(self.folder, f)))
        return {f: n for f in found if (n := _complete(os.path.join(self.folder, f)))}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        # a file that is shorter than it was has begun anew
        begun = {f: start.get(f, 0) if start.get(f, 0) <= n else 0 for f, n in end.items()}
        return [Stretch(os.path.join(self.folder, f), begun[f], n) for f, n in end.items() if begun[f] < n]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        name = os.path.basename(partition.path)
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if not line or at + len(line) > partition.end:
                    break
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), name, at
                at += len(line)


class GrowingLog(DataSource):
    """Format "growing_log": the lines of the files of a folder that match pattern (default "*"), as value,
    file and offset (where the line begins), as the files grow and new ones come."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "value string, file string, offset long"

    def streamReader(self, schema: object) -> GrowingLogReader:
        return GrowingLogReader(self.options["path"], self.options.get("pattern", "*"))


def tailed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of the lines (value, file, offset) of text files that grow, such as a device's log while it
    is captured: every file from its beginning, then what is added. Progress is a byte offset per file, kept
    in the stream's checkpoint, so a restart neither repeats nor loses a line. A line without its end is
    held back until the end has come; a file that has become shorter is read anew. The folder must be
    mounted at the same path on driver and executors."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").option("pattern", pattern).load(folder)
