"""ZIP archives as a data source with a partition a member.

The plan reads each archive's directory (a few kilobytes at its end) and makes a partition of every member that filters on archive,
member or year leave, so a big archive is as many tasks as it has members and one that is not asked for is not opened.
A member is read as a stream of lines: what stands in memory is a batch of them, whatever the member's size.

A file that is no archive, and a member that can't be read to its end, give a row with an ``error`` and no line; the lines before
the damage stay. Paths are files, folders, or patterns in their last part, in any store that pyarrow opens; for one that only
Spark's readers open there is ``archives.archive_lines``.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from io import TextIOWrapper

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "archive string, member string, member_no int, year int, line_no long, header string, text string, error string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
BATCH_LINES, BATCH_CHARS, READERS, WRITE_LINES = 10_000, 1 << 22, 16, 1000

_TESTS = {
    EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, StringStartsWith: lambda v, f: v.startswith(f.value), StringEndsWith: lambda v, f: v.endswith(f.value), StringContains: lambda v, f: f.value in v,
    GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value,
}


@dataclass
class Member(InputPartition):
    archive: str
    member: str | None
    member_no: int | None
    year: int | None
    error: str | None = None

    def __post_init__(self) -> None:
        super().__init__(None)


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path)) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def year_of(name: str) -> int | None:
    """The last four digits together in a name that may be a year."""
    found = re.findall(r"(?<!\d)(?:19|20)\d\d(?!\d{3,})", name)
    return int(found[-1]) if found else None


def _listed(path: str) -> list[str]:
    store, at = open_store(path)
    folder, _, pattern = at.rpartition("/")
    if any(c in pattern for c in "*?["):
        return sorted(i.path for i in store.get_file_info(pafs.FileSelector(folder)) if i.is_file and fnmatch.fnmatch(i.base_name, pattern))
    info = store.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [at] if info.is_file else sorted(i.path for i in store.get_file_info(pafs.FileSelector(at)) if i.is_file and not i.base_name.startswith(("_", ".")))


def _directory(store: pafs.FileSystem, archive: str, wanted: re.Pattern) -> list[Member]:
    year = year_of(archive.rpartition("/")[2])
    try:
        with store.open_input_file(archive) as raw, zipfile.ZipFile(raw) as opened:
            names = [n for n in opened.namelist() if not n.endswith("/") and wanted.fullmatch(n)]
            return [Member(archive, name, number, year) for number, name in enumerate(names)]
    except (zipfile.BadZipFile, ValueError, NotImplementedError) as bad:
        return [Member(archive, None, None, year, f"{type(bad).__name__}: {bad}")]


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.wanted = options["path"], re.compile(options.get("member", r"(?i).*\.csv"))
        self.encoding, self.filters = options.get("encoding", "latin-1"), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("archive", "member", "year"):
                self.filters.append(f)
                if f.attribute[0] != "archive":  # a damaged archive has a row without a member, which the filter above the scan must judge
                    yield f
            else:
                yield f

    def _kept(self, part: Member) -> bool:
        values = ((f, getattr(part, f.attribute[0])) for f in self.filters)
        return all(value is not None and _TESTS[type(f)](value, f) for f, value in values)

    def partitions(self) -> list[Member]:
        store, _ = open_store(self.path)
        about = [f for f in self.filters if f.attribute[0] != "member"]
        names = [n for n in _listed(self.path) if all((v := n if f.attribute[0] == "archive" else year_of(n.rpartition("/")[2])) is not None and _TESTS[type(f)](v, f) for f in about)]
        with ThreadPoolExecutor(READERS) as readers:
            return [m for found in readers.map(lambda n: _directory(store, n, self.wanted), names) for m in found if self._kept(m)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition.error:
            yield _batch(partition, "", [], 0, partition.error)
            return
        store, _ = open_store(self.path)
        header, held, size, at, error = "", [], 0, 0, None
        with store.open_input_file(partition.archive) as raw, zipfile.ZipFile(raw) as opened:
            try:
                with opened.open(partition.member) as stream:
                    for line in TextIOWrapper(stream, encoding=self.encoding, errors="strict", newline=None):
                        line = line.rstrip("\r\n")
                        header = header if at else line.removeprefix("﻿")
                        held.append(line)
                        size, at = size + len(line), at + 1
                        if len(held) >= BATCH_LINES or size >= BATCH_CHARS:
                            yield _batch(partition, header, held, at)
                            held, size = [], 0
            except (zipfile.BadZipFile, zipfile.zlib.error, EOFError, UnicodeDecodeError, NotImplementedError, RuntimeError) as bad:
                error = f"{type(bad).__name__}: {bad}"
        if held:
            yield _batch(partition, header, held, at)
        if error:
            yield _batch(partition, header, [], 0, error)


def _batch(part: Member, header: str, held: list[str], end: int, error: str | None = None) -> pa.RecordBatch:
    n = len(held) or 1
    numbers, texts = (range(end - n, end), held) if held else ([None], [None])
    values = ([part.archive] * n, [part.member] * n, [part.member_no] * n, [part.year] * n, numbers, [header if held else None] * n, texts, [error] * n)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _TYPES, strict=True)], _NAMES)


class MemberSource(DataSource):
    """``spark.read.format("zip_members")``; options: path, member (a pattern that whole names match), encoding."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))


def member_lines(spark: SparkSession, path: str, member: str = r"(?i).*\.csv", encoding: str = "latin-1") -> DataFrame:
    """archive, member, member_no, year (of the archive's name), line_no (from 0), header, text, error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MemberSource)
    return spark.read.format("zip_members").option("member", member).option("encoding", encoding).load(path)


def write_archives(rows: DataFrame, folder: str, encoding: str = "latin-1") -> DataFrame:
    """Write ``rows`` (archive, member, line_no, text) as ZIP files and return archive, members of each.

    One task writes an archive, its members as streams in the order of their names; it appears under its name when whole, so a
    task that is repeated replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(folder)
        store.create_dir(at, recursive=True)
        done: list[tuple[str, int]] = []
        now = member = part = sink = opened = None
        count, held = 0, []

        def give() -> None:
            part.write("".join(held).encode(encoding))
            held.clear()

        def end_archive() -> None:
            give()
            part.close()
            opened.close()
            sink.close()
            store.move(f"{at}/{now[1]}", f"{at}/{now[0]}")
            done.append((now[0], count))

        for batch in batches:
            for archive, name, text in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "text")), strict=True):
                if now is None or archive != now[0]:
                    if now:
                        end_archive()
                    now, member, count = (archive, f"_{uuid.uuid4().hex}.part"), None, 0
                    sink = store.open_output_stream(f"{at}/{now[1]}")
                    opened = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                if name != member:
                    if member is not None:
                        give()
                        part.close()
                    member, count = name, count + 1
                    part = opened.open(name, "w", force_zip64=True)
                held.append(f"{text}\n")
                if len(held) >= WRITE_LINES:
                    give()
        if now:
            end_archive()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["archive", "members"])

    order = ["archive", "member", "line_no"]
    return rows.select(*order, F.col("text")).repartition("archive").sortWithinPartitions(*order).mapInArrow(run, "archive string, members int")
