"""Date arithmetic, parsing, wording and message parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as f
from tidemark.plans.base import query
from tidemark.schema import DATE_COLUMNS
from tidemark.sources import domain as d

_KIND = "o_orderkey % 7"
_DAY = "CAST(o_orderdate AS DATE)"


def _written():
    """One of seven ways to write a day, by key."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 7
    return (
        F.when(k == 0, day.cast("string")).when(k == 1, F.date_format(day, "MMMM d, yyyy")).when(k == 2, F.date_format(day, "d MMM yyyy")).when(k == 3, F.date_format(day, "MMMM yyyy"))
        .when(k == 4, F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" "), F.year(day).cast("string"))).when(k == 5, F.year(day).cast("string")).otherwise(F.concat(F.lit("Spring "), F.year(day).cast("string"), F.lit(" or so")))
    )


@query(
    "date_parsing",
    f"""SELECT o_orderkey AS id, CASE WHEN {_KIND} < 3 THEN 'EXACT' WHEN {_KIND} < 6 THEN 'WINDOW' ELSE 'TBD' END AS kind, CASE WHEN {_KIND} < 3 THEN {_DAY} END AS date_exact,
    CASE {_KIND} WHEN 3 THEN 'MONTH' WHEN 4 THEN 'QUARTER' WHEN 5 THEN 'YEAR' END AS granularity,
    CAST(CASE {_KIND} WHEN 3 THEN date_trunc('month', o_orderdate) WHEN 4 THEN date_trunc('quarter', o_orderdate) WHEN 5 THEN date_trunc('year', o_orderdate) END AS DATE) AS window_start,
    CAST(CASE {_KIND} WHEN 3 THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH WHEN 4 THEN date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH WHEN 5 THEN date_trunc('year', o_orderdate) + INTERVAL 1 YEAR END - INTERVAL 1 DAY AS DATE) AS window_end FROM orders""",
    days=("date_exact", "window_start", "window_end"),
)
def date_parsing(spark, sf_dir):
    rows = d.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _written().alias("text"))
    return f.parsed(rows, F.col("text")).select("id", "kind", "date_exact", "granularity", "window_start", "window_end")


@query(
    "date_ranges",
    f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'RANGE' ELSE 'EXACT' END AS kind, CASE WHEN o_orderkey % 3 <> 0 THEN {_DAY} END AS date_exact, CASE WHEN o_orderkey % 3 = 0 THEN {_DAY} END AS date_start, CASE WHEN o_orderkey % 3 = 0 THEN {_DAY} + 4 END AS date_end FROM orders",
    days=("date_exact", "date_start", "date_end"),
)
def date_ranges(spark, sf_dir):
    """Forward ranges are ranges; reversed and open-ended ones keep their start."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(day.cast("string"), F.lit(" to "), F.date_add(day, 4).cast("string"))).when(k == 1, F.concat(day.cast("string"), F.lit(" – "), F.date_sub(day, 4).cast("string"))).otherwise(F.concat(day.cast("string"), F.lit(" to later")))
    rows = d.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))
    return f.parsed_range(rows, F.col("text")).select("id", "kind", "date_exact", "date_start", "date_end")


@query(
    "date_codec",
    "SELECT event_id, kind, date_exact, date_start, date_end, granularity, window_start, window_end FROM release_events",
    days=("date_exact", "date_start", "date_end", "window_start", "window_end"),
)
def date_codec(spark, sf_dir):
    """Decode to a tagged date and encode it again."""
    rows = d.release_events(spark, sf_dir)
    tagged = rows.select("event_id", F.struct("kind", F.col("date_exact").alias("date"), F.coalesce("date_start", "window_start").alias("start"), F.coalesce("date_end", "window_end").alias("end"), "granularity").alias("t"))
    flat = f.encode(F.col("t.kind"), F.col("t.date"), F.col("t.start"), F.col("t.end"), F.col("t.granularity"))
    return tagged.select("event_id", *[flat[c].alias(c) for c in DATE_COLUMNS])


@query(
    "weekday_before",
    f"SELECT o_orderkey AS id, {_DAY} - CAST(CASE WHEN (dayofweek({_DAY}) - o_orderkey % 7 + 7) % 7 = 0 THEN 7 ELSE (dayofweek({_DAY}) - o_orderkey % 7 + 7) % 7 END + 7 * (o_orderkey % 2) AS INTEGER) AS day FROM orders",
    days=("day",),
)
def weekday_before(spark, sf_dir):
    day = f.weekday_before(F.to_date("o_orderdate"), F.col("o_orderkey") % 7, F.col("o_orderkey") % 2 + 1)
    return d.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), day.alias("day"))


@query(
    "relative_time",
    """SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago'
    ELSE (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS said FROM (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts)) AS BIGINT) AS s FROM events)""",
)
def relative_time(spark, sf_dir):
    now = F.unix_micros(F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")).cast("timestamp"))
    seconds = F.floor((now - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(1_000_000)).cast("bigint")
    return d.read(spark, sf_dir, "events").select("event_id", f.ago(seconds).alias("said"))


@query("prices", "SELECT set_id, '$' || printf('%.2f', floor(price * 100 + 0.5) / 100) AS shown, CAST(floor(100 - 100 * 10 / 12.0::DOUBLE + 0.5) AS INTEGER) AS saving FROM product_sets WHERE price < 1000")
def prices(spark, sf_dir):
    """Cents to text, and the percentage that a year at ten months' price saves."""
    shown = F.concat(F.lit("$"), F.format_string("%.2f", F.floor(F.col("price") * 100 + 0.5) / 100))
    return d.product_sets(spark, sf_dir).where("price < 1000").select("set_id", shown.alias("shown"), F.floor(100 - 100 * 10 / F.lit(12.0) + 0.5).cast("int").alias("saving"))


@query("run_duration", "SELECT run_id, CASE WHEN status <> 'FAILED' THEN CAST(floor(value * 1000) AS BIGINT) END AS ms FROM provider_runs")
def run_duration(spark, sf_dir):
    return d.provider_runs(spark, sf_dir).select("run_id", F.when(F.col("status") != "FAILED", F.floor(F.col("value") * 1000).cast("bigint")).alias("ms"))


@query("canonical_query", "SELECT install_id, '/calendar?game=' || slug || '&month=1998-03&types=PRERELEASE,SHELF' AS path FROM installs")
def canonical_query(spark, sf_dir):
    """Parameters in one order, lists sorted, empty ones left out."""
    wanted = F.array_join(F.array_sort(F.array_intersect(F.split(F.lit("SHELF,BOGUS,PRERELEASE"), ","), F.array(*[F.lit(x) for x in ("SHELF", "PRERELEASE", "PROMO", "SPECIAL")]))), ",")
    path = F.concat(F.lit("/calendar?"), F.concat_ws("&", F.concat(F.lit("game="), "slug"), F.lit("month=1998-03"), F.when(wanted != "", F.concat(F.lit("types="), wanted))))
    return d.installs(spark, sf_dir).select("install_id", path.alias("path"))


@query("local_clock", "SELECT event_id, strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%a') AS weekday, CAST(hour(timezone('America/Los_Angeles', timezone('UTC', ts))) AS INTEGER) AS local_hour FROM events")
def local_clock(spark, sf_dir):
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Los_Angeles"), F.col("ts"))
    return d.read(spark, sf_dir, "events").select("event_id", F.date_format(local, "E").alias("weekday"), F.hour(local).alias("local_hour"))
