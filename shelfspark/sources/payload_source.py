"""A Python data source of captured payload files: spark.read.format("payloads") and spark.readStream.format("payloads").

A folder holds `source=<name>` folders of files with one JSON payload a line. Every file is a partition of its own, read by an
executor through Arrow's file systems; a filter on `source` is pushed down, so files of other sources aren't opened. A line that
is no payload stays as a row with its text in `broken`. As a stream, each batch has the files that came since the last one, by
the time they were written and then by name; files have to be put there whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "source string, external_id string, title string, url string, price_minor long, broken string"


@dataclass
class PayloadFile(InputPartition):
    path: str
    source: str
    written: int

    def place(self) -> list:
        return [self.written, self.path]


def listed(folder: str) -> list[PayloadFile]:
    system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    out = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        parts = info.path.split("/")
        source = next((p.partition("=")[2] for p in reversed(parts[:-1]) if p.startswith("source=")), None)
        if info.type == fs.FileType.File and source is not None and not parts[-1].startswith(("_", ".")):
            out.append(PayloadFile(info.path, source, info.mtime_ns or 0))
    return sorted(out, key=PayloadFile.place)


def parsed(line: str, source: str) -> tuple:
    """A row of the schema; amounts are dollars, whole or with cents."""
    try:
        x = json.loads(line)
        title = str(x["title"]).strip()
        price = x.get("price")
        amount = None if price is None else int(float(str(price).replace("$", "").replace(",", "")) * 100 + 0.5)
        return (source, str(x.get("id") or x.get("url") or title), title, x.get("url"), amount, None)
    except (ValueError, KeyError, TypeError, AttributeError):
        return (source, None, None, None, None, line)


def rows_of(folder: str, file: PayloadFile) -> Iterator[tuple]:
    system = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
    with system.open_input_stream(file.path) as stream:
        rest = b""
        while block := stream.read(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            yield from (parsed(x.decode("utf-8", "replace"), file.source) for x in lines if x.strip())
        if rest.strip():
            yield parsed(rest.decode("utf-8", "replace"), file.source)


class PayloadReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.sources = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("source",):
                wanted = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
                self.sources = wanted if self.sources is None else self.sources & wanted
            else:
                yield f

    def partitions(self) -> Sequence[PayloadFile]:
        return [f for f in listed(self.folder) if self.sources is None or f.source in self.sources]

    def read(self, partition: PayloadFile) -> Iterator[tuple]:
        if partition is not None:
            yield from rows_of(self.folder, partition)


class PayloadStreamReader(DataSourceStreamReader):
    """Offsets are the time and name of the last file read."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"after": [0, ""]}

    def latestOffset(self) -> dict:
        return {"after": max((f.place() for f in listed(self.folder)), default=[0, ""])}

    def partitions(self, start: dict, end: dict) -> Sequence[PayloadFile]:
        return [f for f in listed(self.folder) if start["after"] < f.place() <= end["after"]]

    def read(self, partition: PayloadFile) -> Iterator[tuple]:
        if partition is not None:
            yield from rows_of(self.folder, partition)


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options["path"])

    def streamReader(self, schema) -> PayloadStreamReader:
        return PayloadStreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. Filters reach Python sources only if the session allows it."""
    from ..session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)
