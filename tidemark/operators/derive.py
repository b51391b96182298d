"""Derived prereleases, the release lifecycle, and the reconciliation of what should exist with what does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import is_past, weekday_before
from tidemark.schema import AGREEMENT_DAYS, MAIN_EXPANSION, MAX_LEAD_DAYS, NOT_A_BOOSTER, SLOTS


def slots(spark) -> DataFrame:
    """A handful of fixed rows."""
    return F.broadcast(spark.createDataFrame(SLOTS, "game string, slot string, weekday int, occurrence int"))


def product_has_prerelease(game: Column, code: Column, name: Column, kind: Column) -> Column:
    """Positive evidence by game: a kind, a shape of code, or a shape of name."""
    code, name = F.trim(F.coalesce(code, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    return (
        F.when(game == "magic-the-gathering", F.coalesce(kind.isin("expansion", "core"), F.lit(False)))
        .when(game == "disney-lorcana", code.rlike(r"^\d{1,2}$"))
        .when(game == "one-piece-tcg", code.rlike(r"(?i)^OP-?\d{1,2}$"))
        .when(game == "pokemon-tcg", name.rlike(MAIN_EXPANSION))
        .when(game == "yugioh-tcg", code.rlike("^[A-Z]{4}$") & ~name.rlike(NOT_A_BOOSTER))
        .otherwise(False)
    )


def occurrences(anchors: DataFrame) -> DataFrame:
    """Days that the schedules expect. anchors: event_id, game, day, and further columns, which are kept."""
    found = anchors.join(slots(anchors.sparkSession), "game").withColumn("expected", weekday_before(F.col("day"), F.col("weekday"), F.col("occurrence")))
    lead = F.datediff("day", "expected")
    return found.where((lead > 0) & (lead <= MAX_LEAD_DAYS)).drop("weekday", "occurrence")


def stand_down(derived: DataFrame, sourced: DataFrame) -> DataFrame:
    """Drop derived days near a day that a source states for the same set and region."""
    d, s = derived.alias("d"), sourced.alias("s")
    near = (F.col("d.set_id") == F.col("s.set_id")) & (F.col("d.region") == F.col("s.region")) & (F.abs(F.datediff("d.expected", "s.day")) <= AGREEMENT_DAYS)
    return d.join(s, near, "left_anti")


def reconcile(wanted: DataFrame, existing: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, before, after, action (insert, update, keep, archive)."""
    w = wanted.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_w"))
    e = existing.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_e"))
    action = F.when(F.col("_e").isNull(), "insert").when(F.col("_w").isNull(), "archive").when(F.col("before").eqNullSafe(F.col("after")), "keep").otherwise("update")
    return w.join(e, keys, "full_outer").select(*keys, "before", "after", action.alias("action"))


def lifecycle(events: DataFrame, now: str) -> DataFrame:
    """Live, not overridden, announced or confirmed events whose day or range is past become released; recent if within three days."""
    today = F.lit(now).cast("date")
    due = events.where(~F.col("archived") & ~F.col("is_override") & F.col("status").isin("ANNOUNCED", "CONFIRMED") & is_past(today))
    end = F.coalesce("date_exact", "date_end")
    return due.select("event_id", F.lit("RELEASED").alias("status"), (F.datediff(today, F.date_add(end, 1)) < 3).alias("recent"), (F.col("type") == "SHELF").alias("notify"))
