"""Numbered JSON pages, as a paged service leaves them, as a data source for batch and streaming reads.

``spark.dataSource.register(JsonPages)`` makes ``spark.read.format("json_pages")`` and ``spark.readStream.format(...)`` work.
The folder is anything that pyarrow opens by its URI (a file system, object store or HDFS).
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_SCHEMA = pa.schema([("page", pa.int64()), ("position", pa.int32()), ("item", pa.string())])


class Pages:
    """The pages of a folder: files whose path below it has a number by ``pattern``, from page 1 up to the first that is missing or empty."""

    def __init__(self, path: str, items: str, retries: int, small: int, pattern: str):
        self.path, self.items, self.retries, self.small, self.pattern = path, items.split("."), retries, small, pattern

    def _again(self, f):
        """``f()``, again after an error of the store, a little later each time."""
        for attempt in range(self.retries + 1):
            try:
                return f()
            except OSError as e:
                if attempt == self.retries or isinstance(e, FileNotFoundError):
                    raise
                time.sleep(0.2 * (attempt + 1))

    def files(self) -> dict[int, pyarrow.fs.FileInfo]:
        store, path = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), self.path)
        found = self._again(lambda: store.get_file_info(pyarrow.fs.FileSelector(path, recursive=True)))
        return {int(m[1]): f for f in found if f.is_file and (m := re.search(self.pattern, f.path[len(path.rstrip("/")) :]))}

    def read(self, file: pyarrow.fs.FileInfo) -> list:
        store, _ = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), None)

        def whole() -> bytes:
            with store.open_input_stream(file.path) as f:
                return f.read()

        page = json.loads(self._again(whole))
        for name in self.items:
            page = page.get(name) if isinstance(page, dict) else None
        return page or []

    def end(self, first: int = 1) -> int:
        """The number after the last page with items; only small files are opened to see whether they have any."""
        files, n = self.files(), first
        while n in files and (files[n].size > self.small or self.read(files[n])):
            n += 1
        return n


class Range(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


def _rows(pages: Pages, part: Range) -> Iterator[pa.RecordBatch]:
    files = pages.files()
    for n in range(part.first, part.end):
        items = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in pages.read(files[n])]
        yield pa.RecordBatch.from_pydict({"page": pa.array([n] * len(items), pa.int64()), "position": pa.array(range(len(items)), pa.int32()), "item": pa.array(items, pa.string())}, schema=_SCHEMA)


def _ranges(first: int, end: int, size: int) -> list[Range]:
    return [Range(n, min(n + size, end)) for n in range(first, end, size)] or [Range(first, first)]


class _Batch(DataSourceReader):
    def __init__(self, pages: Pages, size: int):
        self.pages, self.size = pages, size

    def partitions(self) -> list[Range]:
        return _ranges(1, self.pages.end(), self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _rows(self.pages, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, pages: Pages, size: int):
        self.pages, self.size, self.seen = pages, size, 1

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 1}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = self.pages.end(self.seen)
        return {"page": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges(start["page"], end["page"], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _rows(self.pages, partition)

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


class JsonPages(DataSource):
    """``page``, ``position`` and ``item`` (JSON) of the numbered pages in ``path``, up to the first missing or empty page.

    Options: ``items``, the dotted path of a page's list (default hits.hits); ``pagesPerTask`` (64); ``retries`` (2) after
    errors of the store; ``smallBytes`` (4096): a file of more bytes has items, so that it needs no look for the end;
    ``pattern``, where a page's number stands in its path below the folder (default: the one number of a ``.json`` file's name).
    As a stream, each batch has the pages that came since the last.
    """

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "page long, position int, item string"

    def _pages(self) -> tuple[Pages, int]:
        o = self.options
        return Pages(o["path"], o.get("items", "hits.hits"), int(o.get("retries", 2)), int(o.get("smallBytes", 4096)), o.get("pattern", r"/[^\d/]*(\d+)[^\d/]*\.json$")), int(o.get("pagesPerTask", 64))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(*self._pages())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(*self._pages())
