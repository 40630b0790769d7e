"""Paged text files as a data source: a row for each page, planned by files and ranges of pages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .files import file_system

SCHEMA = "file string, page int, page_text string"
ARROW = pa.schema([("file", pa.string()), ("page", pa.int32()), ("page_text", pa.string())])
BLOCK = 1 << 20  # bytes read at a time
BATCH = 8 << 20  # bytes of text in a batch of rows
TASK = 128 << 20  # bytes of a task; opening a file counts as a block


@dataclass(frozen=True)
class PageRange:
    """Pages first to last of a file; without last, all from first on. Pages up to `declared` that the file lacks are empty."""

    file: str
    first: int
    last: int | None
    declared: bool


@dataclass
class PageTask(InputPartition):
    ranges: list[PageRange]


def pages_between(stream, mark: bytes, first: int, last: int | None) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of a stream's pages; one page is held at a time. What follows the last mark is a page unless it's blank."""
    number, held = 1, []
    while block := stream.read(BLOCK):
        for i, piece in enumerate(block.split(mark)):
            if i:
                if number >= first:
                    yield number, b"".join(held)
                number, held = number + 1, []
                if last is not None and number > last:
                    return
            if number >= first:
                held.append(piece)
    if number >= first and (rest := b"".join(held)).strip():
        yield number, rest


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.counts = options["path"], options.get("counts")
        self.mark = options.get("mark", "\f").encode()
        self.pages_per_task = int(options.get("pagesPerTask", 4096))
        if len(self.mark) != 1:
            raise ValueError("a page mark is one ASCII character")
        if self.pages_per_task < 1:
            raise ValueError("pagesPerTask is at least 1")
        self.first, self.last, self.files = 1, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of page and names of files; the others are left to Spark."""
        for f in filters:
            column, value = ".".join(f.attribute) if hasattr(f, "attribute") else "", getattr(f, "value", None)
            if column == "file" and isinstance(f, (EqualTo, In)):
                names = set(value) if isinstance(f, In) else {value}
                self.files = names if self.files is None else self.files & names
            elif column == "page" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self._end(value - isinstance(f, LessThan))
            else:
                yield f

    def _end(self, last: int) -> None:
        self.last = last if self.last is None else min(self.last, last)

    def _ranges(self, name: str, declared: int | None) -> Iterator[PageRange]:
        last = min((n for n in (self.last, declared) if n is not None), default=None)
        if last is None:
            yield PageRange(name, self.first, None, False)
            return
        step = self.pages_per_task if declared is not None else max(last, 1)
        for first in range(self.first, last + 1, step):
            yield PageRange(name, first, min(first + step - 1, last), declared is not None)

    def partitions(self) -> list[PageTask]:
        """Many small files make one task, and the ranges of a file of many declared pages a task each."""
        fs, base = file_system(self.folder)
        declared: dict[str, int] = {}
        if self.counts:
            own, path = file_system(self.counts)
            found = pads.dataset(path, filesystem=own, format="parquet").to_table(columns=["file", "pages"])
            declared = {f: n for f, n in zip(found["file"].to_pylist(), found["pages"].to_pylist()) if n is not None}
        tasks, size = [PageTask([])], 0
        infos = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        for info in sorted((i for i in infos if i.type == pafs.FileType.File), key=lambda i: i.path):
            name = info.path[len(base.rstrip("/")) + 1 :]
            if any(part[0] in "_." for part in name.split("/")) or (self.files is not None and name not in self.files):
                continue
            for n, part in enumerate(self._ranges(name, declared.get(name))):
                if tasks[-1].ranges and (n or size + info.size + BLOCK > TASK):
                    tasks.append(PageTask([]))
                    size = 0
                tasks[-1].ranges.append(part)
                size += info.size + BLOCK
        return tasks

    def _rows(self, ranges: list[PageRange]) -> Iterator[tuple[str, int, bytes]]:
        fs, base = file_system(self.folder)
        for r in ranges:
            done = r.first - 1
            with fs.open_input_stream(f"{base}/{r.file}") as stream:
                for done, text in pages_between(stream, self.mark, r.first, r.last):
                    yield r.file, done, text
            for n in range(done + 1, r.last + 1) if r.declared else ():
                yield r.file, n, b""

    def read(self, partition: PageTask) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for file, page, text in self._rows(partition.ranges):
            rows.append((file, page, text.decode("utf-8", "replace")))
            size += len(text) + 64
            if size >= BATCH:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class PagedText(DataSource):
    """Format `paged_text`; options path, mark, counts (a Parquet table of file and pages) and pagesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "paged_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def pages(spark: SparkSession, folder: str, counts: str | None = None, mark: str = "\f", pages_per_task: int = 4096) -> DataFrame:
    """file (below the folder), page (from 1), page_text of every file; names that begin with _ or . are left out.

    A file of declared pages gives just so many: further ones are cut off, those it lacks are empty; other files give the
    pages they hold, none if they are blank. Filters on file and on bounds of page decide which files are opened and how far
    they are read. Bytes that aren't UTF-8 become replacement characters. Planning holds a row a file, as any file listing
    does. A range of pages is found by reading its file up to there, so a task's reading grows with the place of its range;
    a file without a count is one task.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedText)
    reader = spark.read.format("paged_text").option("mark", mark).option("pagesPerTask", pages_per_task)
    return (reader.option("counts", counts) if counts else reader).load(folder)
