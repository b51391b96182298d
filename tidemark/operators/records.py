"""Stored records as snapshots: what a change makes of them. Old table and changes in, new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import REPEAT_HOURS, STALE_HOURS


def open_reviews(items: DataFrame, flags: DataFrame) -> DataFrame:
    """items (event_id, reason, detail, resolved) after flags (event_id, reason, detail): an open item is refreshed, a resolved one never reopened."""
    key = ["event_id", "reason"]
    new = flags.select(*key, F.col("detail").alias("_new"))
    refreshed = items.join(new, key, "left").withColumn("detail", F.when(~F.col("resolved") & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("detail"))).drop("_new")
    opened = flags.join(items.where("NOT resolved"), key, "left_anti").select(*key, "detail", F.lit(False).alias("resolved"))
    return refreshed.select(*opened.columns).unionByName(opened)


def resolve_reviews(events: DataFrame, items: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and items (event_id, resolved_note) after decisions (event_id, choice, day, note). An accepted day becomes the event's and pins it; what is resolved stays."""
    words = F.when(F.col("choice") == "accept", "Accepted day").when(F.col("choice") == "keep", "Kept the currently published date").otherwise("Dismissed")
    made = items.where("resolved_note IS NULL").join(decisions, "event_id").select("event_id", "choice", F.col("day").alias("_day"), F.coalesce(F.nullif(F.trim("note"), F.lit("")), words).alias("_note"))
    accepted = made.where("choice = 'accept' AND _day IS NOT NULL").select("event_id", "_day")
    pin = F.col("_day").isNotNull()
    rows = events.join(accepted, "event_id", "left")
    spans = ["date_start", "date_end", "granularity", "window_start", "window_end"]
    pinned = rows.withColumns({"kind": F.when(pin, "EXACT").otherwise(F.col("kind")), "date_exact": F.coalesce("_day", "date_exact"), "is_override": pin | F.col("is_override"), **{c: F.when(~pin, F.col(c)) for c in spans if c in events.columns}}).drop("_day")
    noted = items.join(made.select("event_id", "_note"), "event_id", "left").withColumn("resolved_note", F.coalesce("resolved_note", "_note")).drop("_note")
    return pinned, noted


def younger_than(rows: DataFrame, column: str, now: str, days: int) -> DataFrame:
    """Rows without a time, or with one within so many days."""
    cutoff = F.to_timestamp_ntz(F.lit(now)) - F.make_dt_interval(F.lit(days))
    return rows.where(F.col(column).isNull() | (F.col(column) >= cutoff))


def fold(log: DataFrame, keys: list[str], order: list[str], values: list[str], stays: Column) -> DataFrame:
    """The last entry of each key, where it stays."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_x"))
    return last.select(*keys, *[F.col(f"_x.{v}").alias(v) for v in values]).where(stays)


def delete_insert(rows: DataFrame, gone: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti").unionByName(new.join(rows.select(*keys), keys, "left_anti"))


def account_states(users: DataFrame, log: DataFrame, days: int) -> DataFrame:
    """user_id, state, removal_on after a log (user_id, at, action, on) of schedule, cancel, ban and unban. A ban ends a scheduled removal."""
    steps = log.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "action", "on"))).alias("steps"))
    start = F.struct(F.lit(False).alias("banned"), F.lit(None).cast("date").alias("removal"))

    def step(state, x):
        is_ = lambda *names: x["action"].isin(*names)
        banned = F.when(is_("ban"), True).when(is_("unban"), False).otherwise(state["banned"])
        removal = F.when(is_("schedule") & ~state["banned"], F.date_add(x["on"], days)).when(is_("cancel", "ban"), None).otherwise(state["removal"])
        return F.struct(banned.alias("banned"), removal.alias("removal"))

    # An unban gives back no removal: the ban ended it. What was scheduled and then banned and unbanned is active, unless it was scheduled again.
    last = users.join(steps, "user_id", "left").withColumn("s", F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), start, step))
    state = F.when(F.col("s.banned"), "BANNED").when(F.col("s.removal").isNotNull(), "REMOVAL").otherwise("ACTIVE")
    return last.select("user_id", state.alias("state"), F.col("s.removal").alias("removal_on"))


def claim_dates(rows: DataFrame) -> DataFrame:
    """Dates as claims keep them: a day, or the bounds of a range or window."""
    return rows.withColumns({"date_start": F.coalesce("date_start", "window_start"), "date_end": F.coalesce("date_end", "window_end")}).drop("window_start", "window_end", "granularity")


def find_or_create(wanted: DataFrame, events: DataFrame) -> DataFrame:
    """set_id, type, region, event_id, created: the oldest live event of the key that is not derived, or a stable new id. A new event has no date."""
    key = ["set_id", "type", "region"]
    oldest = events.where("NOT archived AND NOT derived").groupBy(*key).agg(F.min("event_id").alias("_id"))
    made = F.concat(F.lit("new-"), F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 12))
    return wanted.join(oldest, key, "left").select(*key, F.coalesce(F.col("_id").cast("string"), made).alias("event_id"), F.col("_id").isNull().alias("created"))


def apply_verdicts(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """events after verdicts (event_id, day, new_status, seen_on): a pinned day stays, last_seen moves only where something was seen."""
    v = verdicts.select("event_id", F.col("day").alias("_day"), "new_status", "seen_on")
    rows = events.join(v, "event_id", "left")
    moved = F.col("new_status").isNotNull() & ~F.col("is_override")
    return rows.withColumns({"day": F.when(moved, F.col("_day")).otherwise(F.col("day")), "status": F.coalesce("new_status", "status"), "last_seen": F.coalesce("seen_on", "last_seen")}).select(*events.columns)


def enrich(sets: DataFrame, found: DataFrame) -> DataFrame:
    """sets (set_id, image_url, image_kind, description, kind) with what rows found (and their place) have: images with their kind and texts only where none is stored, the first
    by place; a kind for a stored image only from a row with the same image; the product's kind from the last row."""
    first = lambda value, where: F.min_by(F.when(where, value), F.when(where, F.col("f.place")))
    rows = sets.alias("s").join(found.alias("f"), "set_id", "left")
    has_image, same = F.col("f.image_url").isNotNull(), F.col("f.image_url") == F.col("s.image_url")
    add = rows.groupBy("set_id").agg(
        first(F.struct(F.col("f.image_url").alias("url"), F.col("f.image_kind").alias("kind")), has_image).alias("_image"),
        first(F.col("f.image_kind"), same & F.col("f.image_kind").isNotNull()).alias("_kind"),
        first(F.col("f.description"), F.col("f.description").isNotNull()).alias("_text"),
        F.max_by(F.when(F.col("f.kind").isNotNull(), F.col("f.kind")), F.when(F.col("f.kind").isNotNull(), F.col("f.place"))).alias("_class"),
    )
    out = sets.join(add, "set_id")
    empty = F.col("image_url").isNull()
    return out.withColumns(
        {"image_kind": F.when(empty, F.col("_image.kind")).otherwise(F.coalesce("image_kind", "_kind")), "image_url": F.coalesce(F.col("image_url"), F.col("_image.url")), "description": F.coalesce("description", "_text"), "kind": F.coalesce("_class", "kind")}
    ).select(*sets.columns)


def retry(runs: DataFrame, again: DataFrame) -> DataFrame:
    """runs (scan_id, provider, status) after another attempt of the failed ones: scan_id, provider, status, retried, still_failing."""
    new = again.select("scan_id", "provider", F.col("status").alias("_status"))
    rows = runs.join(new, ["scan_id", "provider"], "left")
    retried = F.col("_status").isNotNull() & (F.col("status") == "FAILED")
    return rows.select("scan_id", "provider", F.when(retried, F.col("_status")).otherwise(F.col("status")).alias("status"), retried.alias("retried"), (retried & (F.col("_status") == "FAILED")).alias("still_failing"))


def alarms(seen: DataFrame, stored: DataFrame, now: str) -> DataFrame:
    """provider, action (RAISE, REPEAT, KEEP, CLEAR, NONE), opened_at, notified_at from the last good time (provider, since) and the open alarms."""
    at = F.to_timestamp_ntz(F.lit(now))
    hours = lambda since: F.timestamp_diff("HOUR", since, at)
    rows = seen.join(stored, "provider", "left")
    stale, open_ = hours(F.col("since")) >= STALE_HOURS, F.col("opened_at").isNotNull()
    action = F.when(stale & ~open_, "RAISE").when(stale & (hours(F.col("notified_at")) >= REPEAT_HOURS), "REPEAT").when(stale, "KEEP").when(open_, "CLEAR").otherwise("NONE")
    told = F.when(action.isin("RAISE", "REPEAT"), at).when(stale, F.col("notified_at"))
    return rows.select("provider", action.alias("action"), F.when(stale, F.coalesce(F.col("opened_at"), at)).alias("opened_at"), told.alias("notified_at"))


def overlaid(stored: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with this run's in their place, whole."""
    return decided.unionByName(stored.join(decided.select(*keys), keys, "left_anti"))
