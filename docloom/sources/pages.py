"""Pages of files as a data source, and logs that are appended to as a whole: `docloom_pages` and `docloom_log`.

A parser is an object with count(content) -> number of pages, and read(content, first, end) -> an iterator of
(page, text). It is named as "module:attribute". Files are split by ranges of pages, and bounds of pages are options of
the reader, so that ranges outside are not read at all. (Filters are not taken over from Spark: of a frame that is used
for several queries it keeps the reader of the first one, with the bounds of that query.) What is damaged comes as a row
with its error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch
from importlib import import_module

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import prepare

PAGES, LOG = "docloom_pages", "docloom_log"
SCHEMA = "path string, page int, text string, error string"
ARROW = pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())])
PER_TASK = 16
#: Files whose pages are counted at the same time when a read is planned, and rows of a batch.
COUNTING, ROWS = 16, 64
STAGED = "_staged"


class FormFeeds:
    """Plain text in UTF-8 whose pages end with form feeds."""

    def count(self, content: bytes) -> int:
        if b"\0" in content:
            raise ValueError("this is not a text")
        return content.count(b"\f") + 1

    def read(self, content: bytes, first: int, end: int) -> Iterator[tuple[int, str]]:
        for page, text in list(enumerate(content.split(b"\f")))[first:end]:
            yield page, text.decode()


form_feeds = FormFeeds()


def named(name: str):
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def failure(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:200]


@dataclass
class PageRange(InputPartition):
    path: str
    first: int
    end: int
    error: str | None = None


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern, self.parser = options["path"], options.get("pattern", "*"), options.get("parser", f"{__name__}:form_feeds")
        self.per_task = int(options.get("pagesPerTask", PER_TASK))
        self.first, self.end = int(options.get("first", 0)), int(options.get("end", 2**31 - 1))

    def partitions(self) -> list[PageRange]:
        store, root = fs.FileSystem.from_uri(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        paths = sorted(i.path for i in found if i.type == fs.FileType.File and fnmatch(i.base_name, self.pattern) and not i.base_name.startswith(("_", ".")))
        with ThreadPoolExecutor(COUNTING) as pool:
            ranges = [r for some in pool.map(self._ranges, paths) for r in some]
        return ranges or [PageRange("", 0, 0)]

    def _ranges(self, path: str) -> list[PageRange]:
        try:
            end = min(named(self.parser).count(self._content(path)), self.end)
        except Exception as error:  # told as a row
            return [PageRange(path, 0, 0, failure(error))]
        return [PageRange(path, at, min(at + self.per_task, end)) for at in range(self.first, end, self.per_task)]

    def _content(self, path: str) -> bytes:
        store, _ = fs.FileSystem.from_uri(self.root)
        with store.open_input_stream(path) as stream:
            return stream.read()

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows: list[dict] = []
        if partition.error:
            rows.append({"path": partition.path, "page": None, "text": None, "error": partition.error})
        else:
            at, parser, content = partition.first, named(self.parser), self._content(partition.path)
            while at < partition.end:
                try:
                    for page, text in parser.read(content, at, partition.end):
                        rows.append({"path": partition.path, "page": page, "text": text, "error": None})
                        at = page + 1
                        if len(rows) == ROWS:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows = []
                    break
                except Exception as error:  # this page is damaged; those after it are read
                    rows.append({"path": partition.path, "page": at, "text": None, "error": failure(error)})
                    at += 1
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return PAGES

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class LogWriter(DataSourceArrowWriter):
    """Tasks write below a hidden folder; only a whole job's files move into the log, an aborted one leaves nothing."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        folder, name, rows = f"{root}/{STAGED}/{self.job}", f"part-{uuid.uuid4().hex}.json", 0
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    kept = {k: v for k, v in row.items() if v is not None}
                    out.write(json.dumps(kept, ensure_ascii=False, default=str).encode() + b"\n")
                rows += batch.num_rows
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        old = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File] if self.overwrite else []
        for m in messages:
            if m is not None and m.rows:
                store.move(f"{root}/{STAGED}/{self.job}/{m.file}", f"{root}/{m.file}")
        for path in old:
            store.delete_file(path)
        store.delete_dir(f"{root}/{STAGED}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{STAGED}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{STAGED}/{self.job}")


class LogSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return LOG

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with both sources known to it."""
    for source in (PageSource, LogSink):
        prepare(spark).dataSource.register(source)
    return spark


def read_pages(spark: SparkSession, folder: str, parser: str | None = None, pattern: str = "*", first: int | None = None, end: int | None = None) -> DataFrame:
    """(path, page, text, error) of the files below a folder, a URI that pyarrow's file systems open.

    first, end: only pages from first on and before end, counted from 0.
    """
    options = {k: str(v) for k, v in {"path": folder, "parser": parser, "pattern": pattern, "first": first, "end": end}.items() if v is not None}
    return registered(spark).read.format(PAGES).options(**options).load()


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines, all of them or none."""
    registered(rows.sparkSession)
    rows.write.format(LOG).mode("append").option("path", path).save()
