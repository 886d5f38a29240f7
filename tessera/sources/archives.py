"""ZIP archives as tables of lines.

One archive is one task's work and its bytes are one row (archives of tens of megabytes; Spark's limit for a row is 2 GB);
its members are read as streams, so decoded text never stands in memory as a whole. A file that is no archive, or a member
that breaks off or can't be decoded, gives a row with an error and no line. Where pyarrow can open the store, ``zip_members`` reads archives
of any size with a task a member; this reader needs nothing but Spark's.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO, TextIOWrapper

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = "archive string, member string, member_no int, line_no long, header string, text string, error string"
_NAMES = [c.split()[0] for c in LINES.split(", ")]
_BATCH = 10_000


def _error(archive: str, member: str | None, number: int | None, bad: Exception) -> pa.RecordBatch:
    none = pa.array([None], pa.string())
    return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([member], pa.string()), pa.array([number], pa.int32()), pa.array([None], pa.int64()), none, none, pa.array([f"{type(bad).__name__}: {bad}"])], _NAMES)


def archive_lines(spark: SparkSession, path: str, member: str = r"(?i).*\.csv", encoding: str = "latin-1") -> DataFrame:
    """archive, member, member_no, line_no (from 0), header (the member's first line), text: of members whose name matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name_ok = re.compile(member)
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    opened = zipfile.ZipFile(BytesIO(content.as_buffer()))
                except (zipfile.BadZipFile, ValueError, NotImplementedError) as bad:
                    yield _error(archive, None, None, bad)
                    continue
                with opened:
                    names = [n for n in opened.namelist() if not n.endswith("/") and name_ok.fullmatch(n)]
                    for number, name in enumerate(names):
                        yield from _member(opened, archive, name, number, encoding)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, LINES)


def _member(opened: zipfile.ZipFile, archive: str, name: str, number: int, encoding: str) -> Iterator[pa.RecordBatch]:
    header, held, at = "", [], 0

    def batch() -> pa.RecordBatch:
        n = len(held)
        columns = [pa.array([archive] * n), pa.array([name] * n), pa.array([number] * n, pa.int32()), pa.array(range(at - n, at), pa.int64()), pa.array([header] * n), pa.array(held, pa.string()), pa.array([None] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, _NAMES)

    bad = None
    try:
        with opened.open(name) as raw:
            for line in TextIOWrapper(raw, encoding=encoding, errors="strict", newline=None):
                line = line.rstrip("\r\n")
                header = header if at else line.removeprefix("\ufeff")
                held.append(line)
                at += 1
                if len(held) == _BATCH:
                    yield batch()
                    held = []
    except (zipfile.BadZipFile, zipfile.zlib.error, EOFError, UnicodeDecodeError, NotImplementedError, RuntimeError) as found:
        bad = found
    if held:
        yield batch()
    if bad:
        yield _error(archive, name, number, bad)


def text_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Plain files in the same columns, numbered in two passes; the header is the first line of each file.

    A split is read by one task in its order, so a line's number in it is its distance from the split's first, and the numbers of
    lines of the splits before are a running sum over a row a split. No window holds a file's lines.
    """
    raw = F.decode(F.col("value").cast("binary"), encoding)  # the text source itself keeps bytes as they are
    split = F.struct(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("begins"))
    lines = spark.read.text(path).select(split.alias("split"), F.monotonically_increasing_id().alias("place"), raw.alias("text")).select("split.*", "place", "text")
    counts = lines.groupBy("archive", "begins").agg(F.min("place").alias("from"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("archive").orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(counts.withColumn("before", before), ["archive", "begins"]).withColumn("line_no", F.col("before") + F.col("place") - F.col("from"))
    first = numbered.where("line_no = 0").select("archive", F.col("text").alias("header"))
    return numbered.join(first, "archive").select("archive", F.col("archive").alias("member"), F.lit(0).alias("member_no"), "line_no", "header", "text")


def delimited(lines: DataFrame, columns: list[str], separator: str = ";") -> DataFrame:
    """The named columns of delimited records without quoting; ragged rows and headers are dropped, absent columns are null.

    Where a record stood (archive, member, member_no, line_no) travels along: the first of several wins in file order.
    """
    pattern = f"[{separator}]"
    cut = lines.where("line_no > 0").withColumns({"fields": F.split("text", pattern, -1), "names": F.split("header", pattern, -1)}).where("size(fields) = size(names)")

    def field(name: str) -> Column:
        return F.get("fields", (F.array_position("names", F.lit(name)) - 1).cast("int")).alias(name)

    return cut.select("archive", "member", "member_no", "line_no", *(field(c) for c in columns))
