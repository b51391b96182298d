"""Bronze payloads: packing, hashing, skipping what has not changed, and taking JSON, RSS and HTML apart."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.dates import parsed


#: Payloads that a task holds taken apart at a time: a batch of Spark's is many, and pages are long.
STEP = 16


def streamed(rows: DataFrame, column: str, out: str, schema: str, each: Callable[[str | bytes | None], object], many: bool = False) -> DataFrame:
    """The rows without `column` and with `out`, of a type: what `each` makes of the column's value; with `many`, a row for each element of the list it makes.

    A few payloads at a time are taken apart and handed on, so a task's memory doesn't grow with the number of payloads or of what is in them.
    """
    kept = [f for f in rows.schema.fields if f.name not in (column, out)]
    types = T.StructType([*kept, T.StructField(out, T.DataType.fromDDL(schema))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(types).field(out).type
        for batch in (b.slice(k, STEP) for b in batches for k in range(0, b.num_rows, STEP)):
            made = [each(v) for v in batch.column(column).to_pylist()]
            others = pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept], [f.name for f in kept]) if kept else None
            if many:
                times = [len(m) for m in made]
                made = [x for m in made for x in m]
                at = pa.array(np.repeat(np.arange(len(times)), times))
                others = others and others.take(at)
            yield pa.RecordBatch.from_arrays([*(others.columns if others else []), pa.array(made, kind)], types.fieldNames())

    return rows.select(*[f.name for f in kept], column).mapInArrow(run, types)


def gzipped(text: str | None) -> bytes | None:
    """Spark has no gzip function."""
    return None if text is None else gzip.compress(text.encode(), mtime=0)


def gunzip(body: bytes | None) -> str | None:
    """The text of a gzipped body; null where it is none, so that one bad payload makes a row and not a failure."""
    try:
        return None if body is None else gzip.decompress(body).decode()
    except (OSError, EOFError, UnicodeDecodeError):
        return None


def unpacked(payloads: DataFrame) -> DataFrame:
    """The payloads with `text` instead of `body`."""
    return streamed(payloads, "body", "text", "string", gunzip)


def pack(rows: DataFrame, column: str) -> DataFrame:
    return streamed(rows.withColumn("sha256", F.sha2(column, 256)), column, "body", "binary", gzipped).withColumn("body_length", F.octet_length("body"))


def changed(payloads: DataFrame, known: DataFrame) -> DataFrame:
    """Payloads whose hash is not a known one."""
    return payloads.join(known.select("sha256"), "sha256", "left_anti")


def decode(payloads: DataFrame) -> DataFrame:
    """Payloads with `text`, and `error` where the body is no gzip or no JSON."""
    rows = streamed(payloads.withColumn("_body", F.col("body")), "_body", "text", "string", gunzip)
    error = F.when(F.col("body").isNotNull() & F.col("text").isNull(), "body.gunzip").when(F.col("text").isNotNull() & F.expr("try_parse_json(text)").isNull(), "body.json")
    return rows.withColumn("error", error)


def slim(html: Column) -> Column:
    """Without scripts, styles, drawings, links to files and metadata."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|svg)\b.*?</(script|style|svg)>", ""), r"(?i)<(link|meta)\b[^>]*>", "")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def rss(rows: DataFrame, column: str, now: str) -> DataFrame:
    """Items that have title and link; their day is the ISO date, else the RFC one, else now."""
    inside = lambda tag: F.nullif(F.regexp_extract("item", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    items = rows.withColumn("item", F.explode(F.regexp_extract_all(column, F.lit("(?is)<item>(.*?)</item>"), F.lit(1))))
    rfc = F.try_to_date(F.regexp_extract(inside("pubDate"), r"(\d{1,2} \w{3} \d{4})", 1), "dd MMM yyyy")
    out = items.withColumns({"title": inside("title"), "link": inside("link"), "summary": F.coalesce(inside("description"), inside("content:encoded")), "published": F.coalesce(F.try_to_date(F.substring(inside("date"), 1, 10), "yyyy-MM-dd"), rfc, F.lit(now).cast("date"))})
    return out.where("title IS NOT NULL AND link IS NOT NULL").drop("item")


def catalogue(rows: DataFrame, column: str) -> DataFrame:
    """A retail catalogue: groups with their own date; one without borrows the date of the group that its name extends."""
    schema = "results array<struct<groupId: bigint, name: string, abbreviation: string, isSupplemental: boolean, publishedOn: string>>"
    items = rows.select(F.explode(F.from_json(column, schema)["results"]).alias("g"))
    return items.select(F.col("g.groupId").alias("group_id"), F.col("g.name").alias("name"), F.col("g.abbreviation").alias("code"), F.col("g.isSupplemental").alias("supplemental"), F.try_to_date(F.substring("g.publishedOn", 1, 10), "yyyy-MM-dd").alias("day"))


def borrow_dates(groups: DataFrame) -> DataFrame:
    """A supplemental group `X: Y` takes the date of the group X; of equal names the last one by id."""
    parents = groups.where("NOT coalesce(supplemental, false) AND day IS NOT NULL").groupBy(F.lower("name").alias("key")).agg(F.max_by("day", "group_id").alias("_day"))
    key = F.lower(F.trim(F.split("name", ":")[0]))
    return groups.withColumn("key", key).join(parents, "key", "left").withColumn("day", F.when(F.coalesce("supplemental", F.lit(False)), F.col("_day")).otherwise(F.col("day"))).drop("key", "_day")


def prerelease_week(rows: DataFrame) -> DataFrame:
    """A numbered set's date is its prerelease; its shelf date is a week later."""
    two = F.explode(F.array(F.struct(F.lit("PRERELEASE").alias("type"), F.col("day").alias("on")), F.struct(F.lit("SHELF").alias("type"), F.date_add("day", 7).alias("on"))))
    return rows.select("*", two.alias("x")).select(*rows.columns, "x.type", "x.on")


#: Spans beyond these are slips of a page.
MOST_COLUMNS, MOST_ROWS = 20, 100


def _span(value: str | None, most: int) -> int:
    said = (value or "").strip()
    return min(max(int(said), 1), most) if said.isdigit() else 1


def grid_of(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """The rectangle that a table's rows (text, rows, columns of each cell) fill. A fold from row to row carries the cells that are still open, by column: a row's own cells go
    around them. Open cells end with the table, and a row without any cell is none."""
    open_: dict[int, tuple[str, int]] = {}
    grid: list[list[str]] = []

    def carried(row: list[str]) -> None:
        while len(row) in open_:
            column, (text, left) = len(row), open_.pop(len(row))
            if left > 1:
                open_[column] = text, left - 1
            row.append(text)

    for cells in rows:
        row: list[str] = []
        carried(row)
        for text, down, across in cells:
            for _ in range(across):
                if down > 1:
                    open_[len(row)] = text, down - 1
                row.append(text)
                carried(row)
        if row:
            grid.append(row)
    width = max(map(len, grid), default=0)
    return [row + [""] * (width - len(row)) for row in grid]


class _Tables(HTMLParser):
    """The rows of tables, cell by cell with their spans. Nested tables are tables of their own."""

    def __init__(self):
        super().__init__()
        self.done: list[list[list[str]]] = []
        self.stack: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.stack.append({"rows": [], "cell": None})
        elif self.stack and tag == "tr":
            self.close()
            self.stack[-1]["rows"].append([])
        elif self.stack and tag in ("td", "th"):
            self.close()
            a, t = dict(attrs), self.stack[-1]
            if not t["rows"]:
                t["rows"].append([])
            t["cell"] = [[], _span(a.get("rowspan"), MOST_ROWS), _span(a.get("colspan"), MOST_COLUMNS)]

    def close(self):
        t = self.stack[-1]
        if t["cell"]:
            words, down, across = t["cell"]
            t["rows"][-1].append((" ".join("".join(words).split()), down, across))
            t["cell"] = None

    def handle_endtag(self, tag):
        if not self.stack:
            return
        if tag in ("td", "th", "tr", "table"):
            self.close()
        if tag == "table":
            self.done.append(grid_of(self.stack.pop()["rows"]))

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"]:
            self.stack[-1]["cell"][0].append(data)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def tables(html: pd.Series) -> pd.Series:
    """All tables of a page, as grids. Spark has no HTML parser."""

    def grids(page: str | None) -> list:
        parser = _Tables()
        parser.feed(page or "")
        while parser.stack:
            parser.handle_endtag("table")
        return parser.done

    return html.map(grids)


def table_rows(pages: DataFrame, html: str, name_headers: list[str], date_headers: list[str]) -> DataFrame:
    """Rows of the tables that have a name and a date column, found by header in order of preference: page columns, name, and the
    flat date columns. Rows that repeat the header, or whose cells all say the same (banners), are left out."""
    grid = pages.withColumn("grid", F.explode(tables(F.col(html)))).where("size(grid) > 1")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    headed = grid.withColumn("head", F.transform(F.col("grid")[0], plain))
    place = lambda names: F.coalesce(*[F.nullif(F.array_position("head", n), F.lit(0)) for n in names])
    found = headed.withColumns({"_n": place(name_headers), "_d": place(date_headers)}).where("_n IS NOT NULL AND _d IS NOT NULL")
    cells = found.withColumn("row", F.explode(F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(1)))))
    real = cells.where((F.size(F.array_distinct("row")) > 1) & (F.transform("row", plain) != F.col("head")))
    rows = real.withColumns({"name": F.element_at("row", F.col("_n").cast("int")), "date_text": F.element_at("row", F.col("_d").cast("int"))})
    return parsed(rows.select(*pages.columns, "name", "date_text"), F.col("date_text"))


def page_yield(rows: DataFrame, key: str) -> DataFrame:
    """Pages that gave no rows, or none with a date: drift to report."""
    per_page = rows.groupBy(key).agg(F.count("name").alias("rows"), F.count_if(F.col("kind") != "TBD").alias("dated"))
    return per_page.where("rows = 0 OR dated = 0")
