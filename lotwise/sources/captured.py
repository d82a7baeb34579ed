"""Captured pages as a Python data source: ``spark.read.format("captured_pages")`` and ``spark.readStream`` over a folder of files, one page a file.

Options: ``path``; ``fields``, the columns to make (all by default; the text of a page is read only if one of them needs it); ``site``, how pages are read
(by default ``islands``; an unknown name is an error); ``partition_bytes``, text of a task; ``settle``, seconds that a stream leaves a file alone after its
last change. Columns: ``site_dir`` (the first folder below ``path``), ``name`` (the path below it), ``bytes``, ``html``, and what the site's reader gives of a page
(``total``, ``listings``, for pages with an island).

With ``pushdown`` (see ``captured``) filters on ``site_dir``, ``name`` and ``bytes`` choose files before any is read.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

FORMAT = "captured_pages"
#: Columns that the file list has, and those that need a page's text.
LISTED = {"site_dir": "string", "name": "string", "bytes": "bigint"}
READ = {"html": "string", "total": "bigint", "listings": "bigint"}

_ISLAND = re.compile(r'<script id="__NEXT_DATA__" type="application/json"[^>]*>(.*?)</script>', re.DOTALL)


def _island_facts(html: str) -> dict:
    """Of a page with an island: its number of pages, and how many cards it has."""
    found = _ISLAND.search(html)
    try:
        data = json.loads(found.group(1))["props"]["pageProps"]["pageData"]["data"] if found else {}
        total = re.search(r"-?\d+", str((data.get("paginationData") or {}).get("totalPages") or "0").replace(",", ""))
        return {"total": int(total.group()) if total else 0, "listings": len(data.get("listingsData") or [])}
    except (ValueError, KeyError, TypeError, AttributeError):
        return {"total": 0, "listings": 0}


#: What a site's reader makes of a page, by name. A new site is one more entry.
EXTRACTORS: dict[str, Callable[[str], dict]] = {"islands": _island_facts, "plain": lambda html: {"total": None, "listings": None}}


@dataclass
class Files(InputPartition):
    """The files of a task: site folder, name, bytes and path."""

    files: tuple[tuple[str, str, int, str], ...]


class _Pages:
    """What batch and stream share."""

    def __init__(self, options: dict[str, str], fields: list[str]):
        if "path" not in options:
            raise ValueError("captured_pages needs a path")
        self.uri, self.fields = options["path"].rstrip("/"), fields
        self.extract = EXTRACTORS[options.get("site", "islands")]
        self.most = int(options.get("partition_bytes", 8 << 20))
        self.needs_text = bool(set(fields) & set(READ))

    def filesystem(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri) if ":/" in self.uri else (pafs.LocalFileSystem(), self.uri)

    def listing(self) -> list[tuple[str, str, int, str, int]]:
        """All files by name, with the time of their last change; names that begin with a dot or an underscore aren't pages."""
        fs, root = self.filesystem()
        out = []
        for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            inner = f.path[len(root) :].lstrip("/")
            if f.type == pafs.FileType.File and not any(p[0] in "._" for p in inner.split("/")):
                head, _, rest = inner.rpartition("/") if "/" not in inner else inner.partition("/")
                out.append((unquote(head.partition("=")[2] or head), rest, f.size, f.path, f.mtime_ns))
        return sorted(out)

    def dealt(self, files: list[tuple]) -> list[Files]:
        """Files to tasks of about ``partition_bytes`` each."""
        parts, part, size = [], [], 0
        for site, name, n, path, *_ in files:
            if part and size + n > self.most:
                parts.append(Files(tuple(part)))
                part, size = [], 0
            part.append((site, name, n, path))
            size += n
        return [*parts, Files(tuple(part))] if part else parts

    def rows(self, partition: Files) -> Iterator[tuple]:
        fs, _ = self.filesystem()
        for site, name, size, path in partition.files:
            row = {"site_dir": site, "name": name, "bytes": size}
            if self.needs_text:
                with fs.open_input_stream(path) as f:
                    row["html"] = f.read().decode("utf-8", "replace")
                if {"total", "listings"} & set(self.fields):
                    row |= self.extract(row["html"])
            yield tuple(row[c] for c in self.fields)


class PlainReader(DataSourceReader):
    def __init__(self, pages: _Pages):
        self.pages = pages
        self.filters: list[tuple[str, str, object]] = []

    def partitions(self) -> list[Files]:
        return self.pages.dealt([f for f in self.pages.listing() if all(_holds(test, f[("site_dir", "name", "bytes").index(column)], value) for column, test, value in self.filters)]) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.pages.rows(partition)


#: Filters that choose files, and their tests.
_TESTS = {EqualTo: "eq", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", StringStartsWith: "starts", IsNotNull: "there"}


def _holds(test: str, own, value) -> bool:
    if test == "there":
        return own is not None
    if test == "in":
        return own in value
    if test == "starts":
        return own.startswith(value)
    return {"eq": own == value, "gt": own > value, "ge": own >= value, "lt": own < value, "le": own <= value}[test]


class FilteringReader(PlainReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes the filters on the columns of the file list; Spark applies the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in LISTED and type(f) in _TESTS and getattr(f, "value", 0) is not None:
                self.filters.append((column, _TESTS[type(f)], getattr(f, "value", None)))
            else:
                yield f


class StreamReader(DataSourceStreamReader):
    """New files by the time of their last change, then by name."""

    def __init__(self, pages: _Pages, settle: float):
        self.pages, self.settle = pages, settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        ready = (time.time() - self.settle) * 1e9
        changed, path = max(((m, p) for *_, p, m in self.pages.listing() if m <= ready), default=(0, ""))
        return {"changed": changed, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = (start["changed"], start["path"]), (end["changed"], end["path"])
        return self.pages.dealt([f for f in self.pages.listing() if first < (f[4], f[3]) <= last])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are done: the files stay where they are."""


class CapturedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def fields(self) -> list[str]:
        known = LISTED | READ
        fields = [f.strip() for f in self.options.get("fields", ",".join(known)).split(",")]
        if strange := [f for f in fields if f not in known]:
            raise ValueError(f"unknown field: {strange[0]}")
        if (site := self.options.get("site", "islands")) not in EXTRACTORS:
            raise ValueError(f"unknown site: {site}")
        return fields

    def schema(self) -> str:
        return ", ".join(f"{f} {(LISTED | READ)[f]}" for f in self.fields())

    def reader(self, schema: StructType) -> DataSourceReader:
        pages = _Pages(self.options, schema.fieldNames())
        return (FilteringReader if self.options.get("pushdown", "false") == "true" else PlainReader)(pages)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        self.fields()
        return StreamReader(_Pages(self.options, schema.fieldNames()), float(self.options.get("settle", 1)))


def keep_pages(pages: DataFrame, path: str) -> None:
    """Write pages (``site_dir``, ``name``, ``html``) as files below ``path``, one a page, each with a line break at its end. The tasks write them themselves, as
    Spark's writer makes a folder a page and the driver moves them. A file is moved into place when it is whole, so a task can run again."""
    fs, root = _Pages({"path": path}, []).filesystem()
    for r in pages.select("site_dir").distinct().collect():  # sites are few: a folder each
        fs.create_dir(f"{root}/{r.site_dir}", recursive=True)

    def write(rows: Iterator) -> None:
        to, top = _Pages({"path": path}, []).filesystem()
        for r in rows:
            half = f"{top}/{r.site_dir}/.{r.name}-{uuid.uuid4().hex}"
            with to.open_output_stream(half) as f:
                f.write(((r.html or "") + "\n").encode())
            to.move(half, f"{top}/{r.site_dir}/{r.name}")

    pages.select("site_dir", "name", "html").foreachPartition(write)


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def captured(spark: SparkSession, path: str, streaming: bool = False, **options: str) -> DataFrame:
    """The pages below ``path``, in batch or as a stream; filters are pushed into the reader where the session allows that (``PUSHDOWN``)."""
    spark.dataSource.register(CapturedPages)
    reader = spark.readStream if streaming else spark.read
    if not streaming and spark.conf.get(PUSHDOWN, "false") == "true":
        options |= {"pushdown": "true"}
    return reader.format(FORMAT).options(path=path, **options).load()
