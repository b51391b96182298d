"""Dates as flat columns: codec, algebra, parsing and wording. All are expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import DATE_COLUMNS, MONTHS


def primary(prefix: str = "") -> Column:
    """The day that stands for a flat date: its day, or the first of its range or window; null if unknown."""
    return F.coalesce(F.col(f"{prefix}date_exact"), F.col(f"{prefix}date_start"), F.col(f"{prefix}window_start"))


def last_day_of(prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}date_exact"), F.col(f"{prefix}date_end"), F.col(f"{prefix}window_end"))


def overlaps(low: str | None, high: str | None, prefix: str = "") -> Column:
    """Whether a flat date meets [low, high]; either bound may be open. An unknown date meets nothing."""
    start, end = primary(prefix), last_day_of(prefix)
    met = F.col(f"{prefix}kind") != "TBD"
    if high is not None:
        met &= start <= F.lit(high).cast("date")
    if low is not None:
        met &= end >= F.lit(low).cast("date")
    return met


def encode(kind: Column, exact: Column, start: Column, end: Column, granularity: Column) -> dict[str, Column]:
    """Flat columns of a tagged date; a date that lacks a part is unknown."""
    day = (kind == "EXACT") & exact.isNotNull()
    span = (kind == "RANGE") & start.isNotNull() & end.isNotNull()
    window = (kind == "WINDOW") & start.isNotNull() & end.isNotNull() & granularity.isNotNull()
    return {
        "kind": F.when(day, "EXACT").when(span, "RANGE").when(window, "WINDOW").otherwise("TBD"),
        "date_exact": F.when(day, exact),
        "date_start": F.when(span, start),
        "date_end": F.when(span, end),
        "granularity": F.when(window, granularity),
        "window_start": F.when(window, start),
        "window_end": F.when(window, end),
    }


def gap_days(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def is_past(now: Column, prefix: str = "") -> Column:
    """A day or range is past when the day after its end has come; windows and unknown dates never are."""
    return F.col(f"{prefix}kind").isin("EXACT", "RANGE") & (F.date_add(F.coalesce(F.col(f"{prefix}date_exact"), F.col(f"{prefix}date_end")), 1) <= now)


def weekday_before(day: Column, weekday: Column, occurrence: Column) -> Column:
    """The n-th given weekday (0 Sunday) strictly before a day."""
    back = F.pmod(F.dayofweek(day) - 1 - weekday, F.lit(7))
    return F.date_sub(day, (F.when(back == 0, 7).otherwise(back) + 7 * (occurrence - 1)).cast("int"))


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, v)])
    return F.element_at(table, F.lower(name))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The day of a year, a month's name and a number, as text; null if there is none."""
    return _day(year, _month(month), day)


def parsed(df: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """df with the flat date columns of a written date: ISO, month first, day first, month and year, quarter and year, or year; else unknown.

    The text is split once, and its number of words tells which form it can have; no pattern is tried. What later steps use more than once comes out of a
    one-row explode, which the optimizer doesn't fold into them.
    """
    once = lambda c: F.explode(F.array(c))
    last = lambda x, c: F.when(x.endswith(c), F.left(x, F.length(x) - 1)).otherwise(x)
    digits = lambda x, low, high: F.length(x).between(low, high) & (F.translate(x, "0123456789", "") == "")
    n = F.size("_words")
    w = [F.get(F.col("_words"), F.lit(k)) for k in range(3)]
    second = last(w[1], ",")
    us = (n == 3) & digits(second, 1, 2) & digits(w[2], 4, 4)
    eu = (n == 3) & digits(w[0], 1, 2) & digits(w[2], 4, 4)
    my = (n == 2) & digits(w[1], 4, 4)
    quarter = my & (F.length(w[0]) == 2) & F.lower(w[0]).isin("q1", "q2", "q3", "q4")
    month_first = us | (my & ~quarter)
    named = _month(F.when(month_first, last(w[0], ".")).when(eu, last(second, ".")))
    year = F.when(us | eu, w[2]).when(my, w[1]).when((n == 1) & digits(w[0], 4, 4), w[0])
    month = F.when(us | eu | (my & ~quarter), named).when(quarter, F.substring(w[0], 2, 1).cast("int") * 3 - 2).otherwise(1)
    day = F.when(us, second).when(eu, w[0]).otherwise("1")
    exact, iso = us | eu, (n == 1) & (F.length(w[0]) == 10)
    found = F.struct(F.when(iso, F.try_to_date(w[0], "yyyy-MM-dd")).when(year.isNotNull() & month.isNotNull(), _day(year, month, day)).alias("on"), F.when(exact | iso, "EXACT").when(quarter, "QUARTER").when(my, "MONTH").otherwise("YEAR").alias("form"))
    on, form = F.col("_found.on"), F.col("_found.form")
    kind = F.when(on.isNull(), "TBD").when(form == "EXACT", "EXACT").otherwise("WINDOW")
    end = F.last_day(F.add_months(on, F.when(form == "QUARTER", 2).when(form == "YEAR", 11).otherwise(0)))
    flat = encode(kind, on, on, end, form)
    rows = df.withColumn("_words", once(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " "))).withColumn("_found", once(found))
    return rows.withColumns({f"{prefix}{k}": v for k, v in flat.items()}).drop("_words", "_found")


def parsed_range(df: DataFrame, text: Column) -> DataFrame:
    """Like parsed, for text that may be a range with a dash or `to` between two days. Without a later second day the first date stays."""
    rows = df.withColumn("_parts", F.split(text, r"\s+(?:-|–|—|to)\s+"))
    rows = parsed(parsed(rows, F.element_at("_parts", 1), "_a_"), F.try_element_at("_parts", F.lit(2)), "_b_")
    rows = rows.withColumn("_both", F.coalesce((F.size("_parts") == 2) & (F.col("_b_date_exact") > F.col("_a_date_exact")), F.lit(False)))
    both = F.col("_both")
    out = {c: F.col(f"_a_{c}") for c in DATE_COLUMNS} | {
        "kind": F.when(both, "RANGE").otherwise(F.col("_a_kind")),
        "date_exact": F.when(~both, F.col("_a_date_exact")),
        "date_start": F.when(both, F.col("_a_date_exact")),
        "date_end": F.when(both, F.col("_b_date_exact")),
    }
    return rows.withColumns(out).drop("_parts", "_both", *[f"_{s}_{c}" for s in "ab" for c in DATE_COLUMNS])


def wording(prefix: str = "") -> Column:
    """`Jan 5, 2026`, a range of such, `January 2026`, `Q1 2026`, `2026` or `Date unconfirmed`."""
    c = lambda n: F.col(f"{prefix}{n}")
    day = lambda x: F.concat(F.date_format(x, "MMM"), F.lit(" "), F.dayofmonth(x).cast("string"), F.lit(", "), F.year(x).cast("string"))
    return (
        F.when(c("kind") == "EXACT", day(c("date_exact")))
        .when(c("kind") == "RANGE", F.concat(day(c("date_start")), F.lit(" – "), day(c("date_end"))))
        .when(c("granularity") == "MONTH", F.date_format(c("window_start"), "MMMM yyyy"))
        .when(c("granularity") == "QUARTER", F.concat(F.lit("Q"), F.quarter(c("window_start")).cast("string"), F.lit(" "), F.year(c("window_start")).cast("string")))
        .when(c("granularity") == "YEAR", F.year(c("window_start")).cast("string"))
        .otherwise("Date unconfirmed")
    )


def ago(seconds: Column) -> Column:
    """`just now`, or whole minutes, hours or days."""
    unit = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    minutes, hours, days = (F.floor(seconds / F.lit(n)).cast("bigint") for n in (60, 3600, 86400))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(minutes, "minute")).when(seconds < 86400, unit(hours, "hour")).otherwise(unit(days, "day"))
