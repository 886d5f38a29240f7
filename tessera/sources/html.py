"""HTML pages as arrays of elements, one row a page, and their table cells as rows.

A small parser inside Arrow tasks lists a page's elements in document order, each with the number of the last one inside it;
what is read from them is built-in functions over that array, without a shuffle. Null pages have no elements.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import squeeze

ELEMENT = "struct<node:int,last:int,table:int,row:int,part:string,tag:string,attrs:map<string,string>,text:string>"
_TYPE = pa.struct([("node", pa.int32()), ("last", pa.int32()), ("table", pa.int32()), ("row", pa.int32()), ("part", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])

# Tags without content, what a tag's begin ends, where that search stops, and the widest cell of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "thead": {"tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "li": {"li"}, "p": {"p"}, "option": {"option"}}
FENCE = {"table", "ul", "ol", "select", "div"}
WIDEST = 1000

# Markup that needs no tolerance (quoted values, no references), tags whose content is read otherwise; elements and bytes of a batch.
_NAME = r"[A-Za-z][A-Za-z0-9-]*"
_PLAIN = re.compile(rf"""(?P<text>[^<&]+)|<(?:(?P<begin>{_NAME})(?P<attrs>(?:[ \n\t]+{_NAME}=(?:"[^"<>&]*"|'[^'<>&]*'))*)[ \n\t]*(?P<ends>/?)>|/(?P<end>{_NAME})>|!--[A-Za-z0-9_. ]*-->|!DOCTYPE html>)""")
_ATTRIBUTE = re.compile(rf"""({_NAME})=(?:"([^"]*)"|'([^']*)')""")
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp", "math", "svg"}
BATCH_ELEMENTS, BATCH_CHARACTERS = 20_000, 1 << 21


_NONE: list = []
_TOP = {"table": -1, "row": -1, "part": "tbody", "node": -1, "tag": ""}


class _Listing(HTMLParser):
    """Elements of one page; a text is an element of the tag #text, scripts and styles have none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: list, text: str | None = None) -> int:
        rows = self.rows
        at = len(rows)
        above = rows[self.open[-1]] if self.open else _TOP
        table, row, part, holder = above["table"], above["row"], above["part"], above["tag"]
        if holder == "table":
            table, row, part = above["node"], -1, "tbody"
        elif holder == "tr":
            row = above["node"]
        elif holder == "thead" or holder == "tfoot":
            part = holder
        rows.append({"node": at, "last": at, "table": table, "row": row, "part": part, "tag": tag, "attrs": attrs, "text": text})
        return at

    def _close(self, place: int) -> None:
        for node in self.open[place:]:
            self.rows[node]["last"] = len(self.rows) - 1
        del self.open[place:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if ended := ENDS.get(tag):
            cut = None
            for place in range(len(self.open) - 1, -1, -1):
                there = self.rows[self.open[place]]["tag"]
                if there in FENCE:
                    break
                if there in ended:
                    cut = place
            if cut is not None:
                self._close(cut)
        node = self._add(tag, list({k: v or "" for k, v in reversed(attrs)}.items()) if attrs else _NONE)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for place in range(len(self.open) - 1, -1, -1):
            there = self.rows[self.open[place]]["tag"]
            if there == tag:
                return self._close(place)
            if there == "table":
                return None

    def handle_data(self, data: str) -> None:
        if not (self.open and self.rows[self.open[-1]]["tag"] in ("script", "style")):
            self._add("#text", _NONE, data)


def _plain(html: str) -> _Listing | None:
    """A page of plain markup, token by token with what the parser would call; null where anything in it needs the parser."""
    page, at, match = _Listing(), 0, _PLAIN.match
    while at < len(html):
        token = match(html, at)
        if token is None:
            return None
        at = token.end()
        text, begin, attrs, ends, end = token.groups()
        if text:
            page.handle_data(text)
        elif end:
            page.handle_endtag(end.lower())
        elif begin:
            tag = begin.lower()
            if tag in RAW:
                return None
            page.handle_starttag(tag, [(k.lower(), a or b) for k, a, b in _ATTRIBUTE.findall(attrs)] if attrs else _NONE)
            if ends:
                page.handle_endtag(tag)
    return page


def _parsed(html: str) -> _Listing:
    page = _Listing()
    page.feed(html)
    page.close()
    return page


def _listed(html: str | None) -> list[dict]:
    page = _plain(html or "") or _parsed(html or "")
    page._close(0)
    return page.rows


def spread(pages: DataFrame, key: str) -> DataFrame:
    """The pages dealt to all cores: a small file is read in one task, whatever its pages cost."""
    spark = pages.sparkSession
    return pages.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.col(key))


def elements(pages: DataFrame, html: str, key: str | None = None) -> DataFrame:
    """The pages with ``elements``, an array in document order; with a ``key`` they are dealt out by it first."""
    schema = T.StructType([*(f for f in pages.schema if f.name != "elements"), T.StructField("elements", T._parse_datatype_string(f"array<{ELEMENT}>"))])
    kept = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, listed, held, chars = 0, [], 0, 0

            def told(end: int) -> pa.RecordBatch:
                part = batch.slice(begin, end - begin)  # noqa: B023
                return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(listed, pa.list_(_TYPE))], [*kept, "elements"])  # noqa: B023

            for at, one in enumerate(batch.column(html)):
                text = one.as_py()
                listed.append(_listed(text))
                held, chars = held + len(listed[-1]), chars + len(text or "")
                if held >= BATCH_ELEMENTS or chars >= BATCH_CHARACTERS:  # some pages at a time bound memory
                    yield told(at + 1)
                    begin, listed, held, chars = at + 1, [], 0, 0
            if listed:
                yield told(batch.num_rows)

    return (spread(pages.select(*kept), key) if key else pages.select(*kept)).mapInArrow(run, schema)


def has_class(e: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(F.try_element_at(e["attrs"], F.lit("class")), r"\s+"), name), F.lit(False))


def attribute(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def inside(e: Column, test: Callable[[Column], Column] | None = None) -> Column:
    """The elements inside ``e`` that pass the test, in document order."""
    within = F.slice("elements", e["node"] + 2, e["last"] - e["node"])
    return within if test is None else F.filter(within, test)


def texts(e: Column) -> Column:
    return F.transform(inside(e, lambda x: x["tag"] == "#text"), lambda x: x["text"])


def shown(e: Column) -> Column:
    """The text of an element: its parts with spaces between them, squeezed."""
    return squeeze(F.array_join(texts(e), " "))


def joined(e: Column) -> Column:
    """The text of an element without spaces between its parts, squeezed."""
    return squeeze(F.array_join(texts(e), ""))


def tables(test: Callable[[Column], Column]) -> Column:
    """The numbers of the tables that pass the test, in document order."""
    return F.transform(F.filter("elements", lambda e: (e["tag"] == "table") & test(e)), lambda e: e["node"])


def cells(listed: DataFrame, key: str, wanted: Column, tags: tuple[str, ...] = ("td", "th"), also: tuple[str, ...] = (), reads: tuple[str, ...] = ("text", "joined", "marked")) -> DataFrame:
    """key, columns ``also``, table_no, row, part, node, span, cell_class, the texts ``reads``, cell_no, col: of the tables ``wanted`` (their numbers), cells in rows.

    ``col`` is the column at which a cell begins; a span is 1 to 1000, and 1 where it is no number. Rows are dealt by key, so
    what a page's cells tell of each other needs no further shuffle.
    """
    placed = listed.withColumn("_wanted", wanted).withColumn("_cells", F.filter("elements", lambda e: e["tag"].isin(*tags) & (e["row"] >= 0) & F.array_contains("_wanted", e["table"])))
    read = {"text": shown, "joined": joined, "marked": lambda e: shown(F.get(inside(e, lambda x: (x["tag"] == "span") & has_class(x, "txt")), F.lit(0)))}
    told = F.transform("_cells", lambda e: F.struct((F.array_position("_wanted", e["table"]) - 1).cast("int").alias("table_no"), e["row"].alias("row"), e["part"].alias("part"), e["node"].alias("node"), F.least(F.greatest(F.coalesce(attribute(e, "colspan").try_cast("int"), F.lit(1)), F.lit(1)), F.lit(WIDEST)).alias("span"), attribute(e, "class").alias("cell_class"), *(read[name](e).alias(name) for name in reads)))
    rows = placed.select(key, *also, F.explode(told).alias("c")).select(key, *also, "c.*").repartition(F.col(key))
    order = Window.partitionBy(key, "row").orderBy("node")
    before = F.sum("span").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"cell_no": F.row_number().over(order) - 1, "col": F.coalesce(before, F.lit(0)).cast("int")})
