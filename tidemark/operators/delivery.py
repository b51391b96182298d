"""What leaves the system: calendar feeds, JSON-LD, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import ics_escape


def ics_feed(events: DataFrame) -> DataFrame:
    """One all-day entry per day or range; its end is exclusive. Lines end in CR LF."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    start, end = F.coalesce("date_exact", "date_start"), F.date_add(F.coalesce("date_exact", "date_end"), 1)
    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("event_id").cast("string"), F.lit("@tidemark")), F.concat(F.lit("DTSTART;VALUE=DATE:"), day(start)),
        F.concat(F.lit("DTEND;VALUE=DATE:"), day(end)), F.concat(F.lit("SUMMARY:"), ics_escape(F.col("name"))), F.lit("END:VEVENT"),
    ]
    return events.where(F.col("kind").isin("EXACT", "RANGE")).select("event_id", F.concat_ws("\r\n", *lines).alias("vevent"))


def ics_calendars(events: DataFrame, owner: str) -> DataFrame:
    """A whole calendar text for each owner, entries in order of start."""
    entries = events.join(ics_feed(events), "event_id").groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("date_exact", "date_start").alias("start"), "event_id", "vevent"))).alias("e"))
    body = F.array_join(F.transform("e", lambda x: x["vevent"]), "\r\n")
    return entries.select(owner, F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), body, F.lit("END:VCALENDAR")).alias("ics"))


def json_ld(events: DataFrame) -> DataFrame:
    """schema.org events; their end is inclusive."""
    start, end = F.coalesce("date_exact", "date_start"), F.coalesce("date_exact", "date_end")
    body = F.to_json(F.struct(F.lit("Event").alias("@type"), F.col("name").alias("name"), start.cast("string").alias("startDate"), end.cast("string").alias("endDate")))
    return events.where(F.col("kind").isin("EXACT", "RANGE")).select("event_id", body.alias("json"))


def digest_text(items: DataFrame, owner: str, limit: int = 2000) -> DataFrame:
    """A subject that counts, and a body of lines cut at the limit of the channel."""
    n = F.count(F.lit(1))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "line"))), lambda x: x["line"]), "\n")
    subject = F.concat(n.cast("string"), F.lit(" release"), F.when(n == 1, "").otherwise("s"), F.lit(" coming up"))
    return items.groupBy(owner).agg(subject.alias("subject"), F.substring(lines, 1, limit).alias("body"))


def add_to_calendar(name: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Links for two web calendars: one takes an exclusive end, the other an inclusive one."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    google = F.concat(F.lit("https://calendar.google.com/calendar/render?action=TEMPLATE&text="), F.url_encode(name), F.lit("&dates="), day(start), F.lit("/"), day(F.date_add(end, 1)))
    outlook = F.concat(F.lit("https://outlook.live.com/calendar/0/deeplink/compose?subject="), F.url_encode(name), F.lit("&allday=true&startdt="), start.cast("string"), F.lit("&enddt="), end.cast("string"))
    return google, outlook
