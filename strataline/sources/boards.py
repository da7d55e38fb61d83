"""Landed boards as a data source: listings, and a file of details for each posting that is opened only if its listing passes.

Layout, as land() writes it by Spark's own writers:

    listings/board=<board>/part-*.json       external_id, title, location, url
    details/board=<board>/external_id=<id>/part-*.txt

Each board is a partition of the scan; one whose listing passes PART_BYTES is
several, by parts of the listing.  Filters that Spark pushes down are held
against the listing before any details are read, so the details of a posting
that is rejected by its title or place are never opened.  Filters on other
columns, and kinds that aren't known here, stay with Spark.

Defined cases: a board without a listing has no partition; a posting without
details has a null description; a null value passes no comparison, as in SQL.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

LISTING = ("external_id", "title", "location", "url")
SCHEMA = "board string, external_id string, title string, location string, url string, description string"

#: Characters that Spark's writers escape in the name of a part, beside control characters.
_ESCAPED = "\"#%'*/:=?\\{[]^"


def part_name(value: str | None) -> str:
    """How Spark's writers name the part of a value."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 32 or ord(c) == 127 else c for c in value)


#: What each pushed comparison of a value that isn't null means.
_TESTS = {
    EqualTo: lambda x, v: x == v,
    EqualNullSafe: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v,
    StringContains: lambda x, v: v in x,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
}


def holds(told: Filter, row: dict) -> bool | None:
    """Whether a listing passes a filter; None as SQL's unknown."""
    if isinstance(told, Not):
        inner = holds(told.child, row)
        return None if inner is None else not inner
    value = row.get(told.attribute[0])
    if isinstance(told, IsNull | IsNotNull):
        return (value is None) == isinstance(told, IsNull)
    if isinstance(told, EqualNullSafe) and (value is None or told.value is None):
        return value is told.value
    return None if value is None else _TESTS[type(told)](value, told.value)


def known(told: Filter) -> bool:
    """Whether a listing is enough to decide a filter."""
    if isinstance(told, Not):
        return known(told.child)
    return (type(told) in _TESTS or isinstance(told, IsNull | IsNotNull)) and len(told.attribute) == 1 and told.attribute[0] in ("board", *LISTING)


#: Bytes of a board's listing that one partition of the scan reads, about; the details of its postings are opened there.
PART_BYTES = 256 << 10
#: Postings of a part of a listing at most.
PART_ROWS = 1000


@dataclass
class Board(InputPartition):
    name: str
    files: tuple[str, ...]


def shares(files: list[tuple[str, int]], most: int) -> list[tuple[str, ...]]:
    """Names of files (name, bytes) in order, put together up to `most` bytes; one at least."""
    out: list[list[str]] = [[]]
    size = 0
    for name, n in files:
        if out[-1] and size + n > most:
            out.append([])
            size = 0
        out[-1].append(name)
        size += n
    return [tuple(x) for x in out]


class BoardReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for told in filters:
            if known(told):
                self.filters.append(told)
            else:
                yield told

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Board]:
        from pyarrow import fs

        store, root = self._open()
        if store.get_file_info(f"{root}/listings").type == fs.FileType.NotFound:
            return []
        names = sorted(unquote(f.base_name.partition("=")[2]) for f in store.get_file_info(fs.FileSelector(f"{root}/listings")) if f.base_name.startswith("board="))
        alone = [f for f in self.filters if f.attribute == ("board",)] if all(not isinstance(f, Not) for f in self.filters) else []
        kept = [n for n in names if all(holds(f, {"board": n}) for f in alone)]
        return [Board(n, files) for n in kept for files in shares([(f.base_name, f.size or 0) for f in self._parts(store, f"{root}/listings/board={part_name(n)}")], PART_BYTES)]

    def read(self, partition: Board | None) -> Iterator[tuple]:
        if partition is None:  # what Spark makes of no boards
            return
        store, root = self._open()
        folder = f"{root}/listings/board={part_name(partition.name)}"
        for line in (x for name in partition.files for x in self._read(store, f"{folder}/{name}")):
            row = json.loads(line) | {"board": partition.name}
            if all(holds(f, row) for f in self.filters):
                details = "\n".join(self._lines(store, f"{root}/details/board={part_name(partition.name)}/external_id={part_name(row.get('external_id'))}"))
                yield (row["board"], *[row.get(c) for c in LISTING], details or None)

    def _parts(self, store, folder: str) -> list:
        from pyarrow import fs

        return sorted((f for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.startswith("part-")), key=lambda f: f.base_name)

    def _read(self, store, path: str) -> list[str]:
        with store.open_input_stream(path) as s:
            return s.read().decode().splitlines()

    def _lines(self, store, folder: str) -> Iterator[str]:
        for f in self._parts(store, folder):
            yield from self._read(store, f.path)


class LandedBoards(DataSource):
    """spark.read.format("landed_boards").load(path), after read_boards() has made the format known."""

    @classmethod
    def name(cls) -> str:
        return "landed_boards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoardReader:
        return BoardReader(self.options["path"])


def land(postings: DataFrame, path: str) -> None:
    """Writes postings of SCHEMA as listings and details."""
    told = postings.select(*[F.col(c).cast("string").alias(c) for c in ("board", *LISTING, "description")])
    # parts of a listing are of bounded size, so that tasks share a large board
    told.select("board", *LISTING).write.mode("overwrite").option("maxRecordsPerFile", PART_ROWS).partitionBy("board").json(f"{path}/listings")
    told.where("description is not null").select("board", "external_id", "description").write.mode("overwrite").partitionBy("board", "external_id").text(f"{path}/details")


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """All boards under `path`; filters on the listing's columns are pushed into the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedBoards)
    return spark.read.format("landed_boards").load(path)
