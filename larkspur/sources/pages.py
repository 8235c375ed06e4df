"""A streaming source over the pages of a stored timeline: a folder of Parquet files that grows by new files.

Rows are numbered file by file, in the order of the files' names, and row by row; an offset is the number of the next row, so a
page that was handed out is read again, row for row, if its batch runs again after a restart. A later file must sort behind
the earlier ones and no file may change. Row counts come from the files' footers; each page is a partition of its own, read on
an executor from the row groups that hold it, as Arrow batches. Paths are those of pyarrow's file systems (a local path must
be one that all executors share).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from larkspur.sources.files import opened

#: Rows of a page.
PAGE = 1000


def files_of(path: str) -> list[str]:
    """The Parquet files of a table, which is a folder or a file, in the order of their names; marks and hidden files aside."""
    system, inside = opened(path)
    info = system.get_file_info(inside)
    if info.type == pyarrow.fs.FileType.File:
        return [inside]
    found = system.get_file_info(pyarrow.fs.FileSelector(inside, recursive=False))
    return sorted(x.path for x in found if x.type == pyarrow.fs.FileType.File and not x.base_name.startswith(("_", ".")) and x.size)


class Page(InputPartition):
    """Rows low to high of a file, counted from its first."""

    def __init__(self, path: str, file: str, low: int, high: int):
        super().__init__(file)
        self.path, self.file, self.low, self.high = path, file, low, high


class PageReader(DataSourceStreamReader):
    """Offsets are {"row": number}. Counts of files that were seen are kept: they don't change."""

    def __init__(self, path: str, columns: list[str], page: int):
        self.path, self.columns, self.page = path, columns, page
        self.counts: dict[str, int] = {}

    def bounds(self) -> list[tuple[str, int, int]]:
        """(file, number of its first row, of the row behind its last)."""
        system, _ = opened(self.path)
        out, at = [], 0
        for file in files_of(self.path):
            if file not in self.counts:
                with system.open_input_file(file) as data:
                    self.counts[file] = pq.ParquetFile(data).metadata.num_rows
            out.append((file, at, at + self.counts[file]))
            at += self.counts[file]
        return out

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        """All that is there: a batch of many pages has as many partitions."""
        return {"row": max((high for *_, high in self.bounds()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        out = []
        for file, low, high in self.bounds():
            first, last = max(low, start["row"]), min(high, end["row"])
            out += [Page(self.path, file, at - low, min(at + self.page, last) - low) for at in range(first, last, self.page)]
        return out

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        system, _ = opened(partition.path)
        with system.open_input_file(partition.file) as data:
            table = pq.ParquetFile(data)
            at = 0
            for group in range(table.num_row_groups):
                n = table.metadata.row_group(group).num_rows
                low, high = max(partition.low - at, 0), min(partition.high - at, n)
                if low < high:
                    yield from table.read_row_group(group, columns=self.columns).slice(low, high - low).to_batches()
                at += n

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class TimelinePages(DataSource):
    """``spark.readStream.format("timeline_pages").schema(...).load(folder)``; option ``page`` (rows)."""

    @classmethod
    def name(cls) -> str:
        return "timeline_pages"

    def streamReader(self, schema: StructType) -> PageReader:
        return PageReader(self.options["path"], [f.name for f in schema.fields], int(self.options.get("page", PAGE)))


def page_stream(spark: SparkSession, path: str, schema: StructType | str, page: int = PAGE) -> DataFrame:
    """A stream of a stored table's pages in their order, each row once: where a restart goes on is its checkpoint's."""
    spark.dataSource.register(TimelinePages)
    return spark.readStream.format("timeline_pages").schema(schema).option("page", page).load(path)
