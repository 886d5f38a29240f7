"""Records of delimited text whose quoted fields may hold separators, doubled quotes and line breaks.

Whether a line begins inside a quoted field depends on all lines before it, but only by a function of two states (outside, inside), and
such functions can be put together: a line keeps the state, sets it, or swaps it. So the states come from two passes: inside
blocks of ``BLOCK`` lines, and over the blocks' own functions, of which a member has one for each block. No regular expression goes
back over what it has read, and members without an open quote take part in none of it.

Quotes mean what they mean to Python's csv module: one that opens a field quotes it, two inside it are one, what follows the closing one
belongs to the field, and a quote elsewhere is an ordinary character. A line break inside a field is read as ``\\n``. A
field that is never closed goes on to the end of its member. A record must fit in memory.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.folders import stage

#: Lines whose states one window finds.
BLOCK = 1 << 16
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'


def _cell(separator: str) -> tuple[str, str]:
    sep = re.escape(separator)
    return sep, f"[^{sep}]*+"


def opens(text: Column, separator: str = ";") -> Column:
    """Whether a line that begins outside of quotes ends inside of them."""
    sep, rest = _cell(separator)
    return F.contains(text, F.lit('"')) & F.rlike(text, F.lit(rf'^(?:(?:{_QUOTED}"{rest}|(?!"){rest}){sep})*+{_QUOTED}\z'))


def fields(record: Column, separator: str = ";") -> Column:
    """The fields of a whole record, in one pass over it."""
    sep, rest = _cell(separator)
    cut = F.regexp_extract_all(F.concat(F.lit(separator), record), F.lit(f'{sep}({_QUOTED}(?:"{rest})?+|{rest})'), F.lit(1))

    def value(field: Column) -> Column:
        inner = F.regexp_extract(field, f'^"({_QUOTED[1:]})', 1)
        return F.when(F.startswith(field, F.lit('"')), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), F.substr(field, F.length(inner) + 3))).otherwise(field)

    return F.when(F.contains(record, F.lit('"')), F.transform(cut, value)).otherwise(F.split(record, sep, -1))


def _before(of: list[str], order: str) -> tuple[Column, Column]:
    """What the rows before this one make of the state: the state they set, if any, and whether they swap it (after that).

    Rows have ``sets`` (null, 0 or 1) and ``swaps`` (0 or 1, where they set nothing).
    """
    before = Window.partitionBy(*of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swapped = F.coalesce(F.sum("swaps").over(before), F.lit(0))
    # ``total``: swaps up to and with the row; a row that sets has none itself.
    last = F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", "total")), ignorenulls=True).over(before)
    return F.when(last.isNotNull(), F.pmod(last["sets"] + swapped - last["total"], F.lit(2))), F.pmod(swapped, F.lit(2))


def _total(of: list[str], order: str) -> Column:
    return F.sum("swaps").over(Window.partitionBy(*of).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def whole_records(lines: DataFrame, separator: str = ";") -> DataFrame:
    """``lines`` with those of one record joined: ``line_no`` is that of its first line, ``header`` the member's first record.

    Columns: archive, member, member_no, line_no (from 0, without gaps in a member), header, text. Rows without a line number stay as they are.
    ``lines`` is read several times: give a written table where reading it is dear. Lines with the state of their block, and with the
    record they belong to, are written on the way, each once. Tables of a row a member or a block are broadcast.
    """
    names = ["archive", "member", "member_no", "line_no", "header", "text"]
    member = ["archive", "member_no"]
    lines = lines.select(*names)
    open_members = F.broadcast(stage(lines.where(opens(F.col("text"), separator)).select(*member).distinct(), "open"))
    plain = lines.join(open_members, member, "left_anti")
    ends, goes_on = opens(F.col("text"), separator).cast("int"), F.when(~F.contains("text", F.lit('"')), F.lit(1)).otherwise(opens(F.concat(F.lit('"'), "text"), separator).cast("int"))
    # Their header is replaced by a whole one, so it does not travel.
    read = lines.drop("header").join(open_members, member, "left_semi").where("line_no is not null").withColumn("block", F.floor(F.col("line_no") / BLOCK)).withColumns({"outside": ends, "inside": goes_on})
    read = read.withColumns({"sets": F.when(F.col("outside") == F.col("inside"), F.col("outside")), "swaps": ((F.col("outside") == 1) & (F.col("inside") == 0)).cast("int")})
    block = [*member, "block"]
    read = read.withColumn("total", _total(block, "line_no"))
    set_to, swap = _before(block, "line_no")
    read = stage(read.withColumns({"set_before": set_to, "swap_before": swap}).drop("sets", "swaps", "total"), "states")

    # The functions of the blocks, and by them the state in which each block begins; a row a block.
    last = F.max(F.struct("line_no", "set_before", "swap_before", "outside", "inside")).alias("last")
    blocks = read.groupBy(*block).agg(last)
    after = lambda state: F.when(state == 1, F.col("last.inside")).otherwise(F.col("last.outside"))
    from_0, from_1 = (after(F.coalesce("last.set_before", F.pmod(F.lit(s) + F.col("last.swap_before"), F.lit(2)))) for s in (0, 1))
    blocks = blocks.select(*block, from_0.alias("out_0"), from_1.alias("out_1")).withColumns({"sets": F.when(F.col("out_0") == F.col("out_1"), F.col("out_0")), "swaps": ((F.col("out_0") == 1) & (F.col("out_1") == 0)).cast("int")})
    blocks = blocks.withColumn("total", _total(member, "block"))
    set_to, swap = _before(member, "block")
    blocks = blocks.select(*block, F.coalesce(set_to, swap).alias("begins"))

    state = F.coalesce("set_before", F.pmod(F.col("begins") + F.col("swap_before"), F.lit(2)))
    told = read.join(F.broadcast(blocks), block).withColumn("inside_before", state).withColumn("starts", F.when(F.col("inside_before") == 0, F.col("line_no")))
    so_far = Window.partitionBy(*block).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = stage(told.withColumn("start", F.max("starts").over(so_far)).drop("set_before", "swap_before", "begins", "inside"), "placed")
    earlier = own.groupBy(*block).agg(F.max("starts").alias("latest")).select(*block, F.max("latest").over(Window.partitionBy(*member).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    placed = own.join(F.broadcast(earlier), block).withColumn("start", F.coalesce("start", "carried"))
    alone = (F.col("inside_before") == 0) & (F.col("outside") == 0)
    # Only lines of records with several lines are brought together.
    joined = placed.where(~alone).groupBy(*member, "start").agg(F.first("member").alias("member"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    bare = [c for c in names if c != "header"]
    records = placed.where(alone).select(*bare).unionByName(joined.withColumnRenamed("start", "line_no").select(*bare))
    first = records.where("line_no = 0").select(*member, F.col("text").alias("header"))
    records = records.join(F.broadcast(first), member).select(*names)
    return plain.unionByName(records).unionByName(lines.join(open_members, member, "left_semi").where("line_no is null"))


def named(lines: DataFrame, columns: list[str] | tuple[str, ...], separator: str = ";") -> DataFrame:
    """The named columns of records: archive, member, member_no, line_no and the columns as text; short records end in nulls, blank ones are skipped."""
    cut = lines.where("line_no > 0 and trim(text) <> ''").withColumns({"fields": fields(F.col("text"), separator), "names": fields(F.col("header"), separator)})
    return cut.select("archive", "member", "member_no", "line_no", *(F.get("fields", (F.array_position("names", F.lit(c)) - 1).cast("int")).alias(c) for c in columns))
