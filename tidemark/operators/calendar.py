"""The calendar: filters, joins to sets and installs, suppression of superseded rows, order, and what a viewer may see."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import last_day_of, overlaps, primary


@dataclass(frozen=True)
class CalendarFilter:
    """Empty lists and None filter nothing."""

    installs: list[int] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    search: str | None = None
    low: str | None = None
    high: str | None = None

    def column(self) -> Column:
        parts = [~F.col("archived")]
        for name, values in (("install_id", self.installs), ("type", self.types), ("status", self.statuses), ("kind", self.kinds)):
            if values:
                parts.append(F.col(name).isin(*values))
        if self.search:
            found = F.lit(self.search.lower())
            parts.append(F.lower("name").contains(found) | F.lower("code").contains(found))
        if self.low is not None or self.high is not None:
            parts.append(overlaps(self.low, self.high))
        return reduce(and_, parts)


def star(events: DataFrame, sets: DataFrame, installs: DataFrame) -> DataFrame:
    """Events with their set and install."""
    sets = sets.select("set_id", "install_id", "name", "code")
    return events.join(sets, "set_id").join(installs, "install_id")


def without_superseded(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Drop undated prereleases where a dated live one exists for the same set and region, whatever the caller filtered."""
    dated = events.where((F.col("type") == "PRERELEASE") & (F.col("kind") != "TBD") & ~F.col("archived")).select("set_id", "region").distinct().withColumn("_dated", F.lit(True))
    open_ = (F.col("type") == "PRERELEASE") & (F.col("kind") == "TBD")
    return rows.join(dated, ["set_id", "region"], "left").where(~(open_ & F.coalesce("_dated", F.lit(False)))).drop("_dated")


def calendar(events: DataFrame, sets: DataFrame, installs: DataFrame, wanted: CalendarFilter) -> DataFrame:
    found = star(events, sets, installs).where(wanted.column())
    return without_superseded(found, events)


def ordered(rows: DataFrame) -> DataFrame:
    """By day, range start, window start (unknown first), then name and id."""
    keys = [F.col(c).asc_nulls_first() for c in ("date_exact", "date_start", "window_start")]
    return rows.orderBy(*keys, "name", "event_id")


def for_viewer(rows: DataFrame, premium: bool, signed_in: bool) -> DataFrame:
    """Images for premium viewers, descriptions for signed-in ones; flags tell what is held back."""
    return rows.withColumns(
        {
            "has_image": F.col("image_url").isNotNull(),
            "has_description": F.col("description").isNotNull(),
            "image_url": F.when(F.lit(premium), F.col("image_url")),
            "description": F.when(F.lit(signed_in), F.col("description")),
        }
    )


def month_grid(rows: DataFrame, low: str, high: str) -> DataFrame:
    """Every day of a month with the number of events that cover it and its first three statuses; empty days too."""
    spark = rows.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(low).cast("date"), F.lit(high).cast("date"))).alias("day"))
    covered = rows.where(overlaps(low, high)).select(
        "status", F.explode(F.sequence(F.greatest(primary(), F.lit(low).cast("date")), F.least(last_day_of(), F.lit(high).cast("date")))).alias("day")
    )
    per_day = covered.groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.slice(F.array_sort(F.collect_set("status")), 1, 3).alias("statuses"))
    return days.join(per_day, "day", "left").select("day", F.coalesce("events", F.lit(0)).cast("bigint").alias("events"), F.coalesce(F.array_join("statuses", ","), F.lit("")).alias("statuses"))


def top_by(rows: DataFrame, partition: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def recipients(followed: DataFrame, subscribers: DataFrame, loved: DataFrame) -> DataFrame:
    """How many users hear of each event: subscribers (install_id, user_id) of the installs that it is followed by (event_id, install_id), and those who loved it (event_id, user_id), each once.

    Events followed by the same installs have the same subscribers, so these are counted once for each such list of installs; pairs of events and subscribers are never made.
    """
    lists = followed.where("install_id IS NOT NULL").groupBy("event_id").agg(F.array_sort(F.collect_set("install_id")).alias("installs"))
    each = lists.select("installs").distinct().select("installs", F.explode("installs").alias("install_id"))
    counted = each.join(subscribers, "install_id").select("installs", "user_id").distinct().groupBy("installs").agg(F.count(F.lit(1)).alias("n"))
    told = lists.join(counted, "installs").select("event_id", "n")
    heard = loved.distinct().alias("l").join(followed.alias("f"), "event_id").join(subscribers.alias("s"), F.expr("f.install_id = s.install_id AND l.user_id <=> s.user_id")).select("event_id", "l.user_id").distinct()
    more = loved.distinct().alias("l").join(heard.alias("h"), F.expr("l.event_id = h.event_id AND l.user_id <=> h.user_id"), "left_anti").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return told.unionByName(more).groupBy("event_id").agg(F.sum("n").alias("recipients"))
