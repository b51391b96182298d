"""Calendar and dashboard queries: filters, joins, sorts and top rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.dates import is_past, overlaps, primary, wording
from tidemark.operators.calendar import CalendarFilter, calendar, for_viewer, month_grid, ordered, recipients, star, top_by, without_superseded
from tidemark.plans.base import query
from tidemark.sources import domain as d

_ROW = ["event_id", "set_id", "install_id", "name", "code", "type", "status", "region", "kind"]
_STAR = "release_events JOIN product_sets USING (set_id) JOIN installs USING (install_id)"
_ROWS = "event_id, set_id, install_id, name, code, type, status, region, kind"
_OVER = "((kind = 'EXACT' AND date_exact BETWEEN DATE '{0}' AND DATE '{1}') OR (kind = 'RANGE' AND date_start <= DATE '{1}' AND date_end >= DATE '{0}') OR (kind = 'WINDOW' AND window_start <= DATE '{1}' AND window_end >= DATE '{0}'))"
_KEPT = "NOT (e.type = 'PRERELEASE' AND e.kind = 'TBD' AND EXISTS (SELECT 1 FROM release_events x WHERE x.type = 'PRERELEASE' AND x.kind <> 'TBD' AND NOT x.archived AND x.set_id = e.set_id AND x.region = e.region))"


def _all(spark, sf_dir):
    return d.release_events(spark, sf_dir), d.product_sets(spark, sf_dir), d.installs(spark, sf_dir)


def _sql(where: str) -> str:
    return f"SELECT {_ROWS} FROM {_STAR.replace('release_events', 'release_events e', 1)} WHERE NOT archived AND {where} AND {_KEPT}"


@query("calendar_upcoming", _sql("type IN ('SHELF', 'PRERELEASE') AND region IN ('NA', 'EU') AND " + _OVER.format("1997-01-01", "1997-03-31")))
def upcoming(spark, sf_dir):
    wanted = CalendarFilter(types=["SHELF", "PRERELEASE"], low="1997-01-01", high="1997-03-31")
    rows = calendar(*_all(spark, sf_dir), wanted).where(F.col("region").isin("NA", "EU"))
    return ordered(rows).select(*_ROW)


@query("calendar_undated", _sql("kind = 'TBD' AND status IN ('RUMORED', 'ANNOUNCED')"))
def undated(spark, sf_dir):
    return calendar(*_all(spark, sf_dir), CalendarFilter(kinds=["TBD"], statuses=["RUMORED", "ANNOUNCED"])).select(*_ROW)


@query("calendar_search", _sql("(lower(name) LIKE '%ring%' OR lower(code) LIKE '%ring%') AND install_id IN (1, 2)"))
def search(spark, sf_dir):
    return calendar(*_all(spark, sf_dir), CalendarFilter(search="RING", installs=[1, 2])).select(*_ROW)


@query("calendar_open_bound", _sql("kind <> 'TBD' AND coalesce(date_exact, date_end, window_end) >= DATE '2001-06-01'"))
def open_bound(spark, sf_dir):
    return calendar(*_all(spark, sf_dir), CalendarFilter(low="2001-06-01")).select(*_ROW)


@query("calendar_starting_on", f"SELECT event_id, name FROM {_STAR} WHERE NOT archived AND coalesce(date_exact, date_start, window_start) = DATE '1998-03-01'")
def starting_on(spark, sf_dir):
    return star(*_all(spark, sf_dir)).where(~F.col("archived") & (primary() == F.lit("1998-03-01").cast("date"))).select("event_id", "name")


@query("calendar_superseded", f"SELECT e.event_id, e.set_id, e.region FROM release_events e WHERE e.kind = 'TBD' AND {_KEPT}")
def superseded(spark, sf_dir):
    events = d.release_events(spark, sf_dir)
    return without_superseded(events.where("kind = 'TBD'"), events).select("event_id", "set_id", "region")


@query(
    "calendar_viewer",
    """SELECT event_id, name IS NOT NULL AS has_image, code IS NOT NULL AS has_description, CAST(NULL AS VARCHAR) AS image_url, code AS description
    FROM release_events JOIN product_sets USING (set_id) WHERE NOT archived AND type = 'PROMO'""",
)
def viewer(spark, sf_dir):
    events, sets, installs = _all(spark, sf_dir)
    rows = star(events, sets, installs).where("NOT archived AND type = 'PROMO'").withColumns({"image_url": F.col("name"), "description": F.col("code")})
    return for_viewer(rows, premium=False, signed_in=True).select("event_id", "has_image", "has_description", "image_url", "description")


@query(
    "calendar_month_grid",
    f"""SELECT CAST(day AS DATE) AS day, CAST(count(event_id) AS BIGINT) AS events, coalesce(array_to_string(list_sort(list(DISTINCT status) FILTER (status IS NOT NULL))[1:3], ','), '') AS statuses
    FROM (SELECT unnest(generate_series(DATE '1998-02-01', DATE '1998-02-28', INTERVAL 1 DAY)) AS day) days
    LEFT JOIN (SELECT * FROM release_events WHERE NOT archived AND {_OVER.format("1998-02-01", "1998-02-28")}) e
      ON day BETWEEN coalesce(date_exact, date_start, window_start) AND coalesce(date_exact, date_end, window_end) GROUP BY day""", days=("day",))
def grid(spark, sf_dir):
    return month_grid(d.release_events(spark, sf_dir).where("NOT archived"), "1998-02-01", "1998-02-28")


@query(
    "calendar_list_order",
    f"SELECT event_id, row_number() OVER (ORDER BY coalesce(date_exact, date_start, window_start) ASC NULLS LAST, event_id) AS place FROM {_STAR} WHERE status = 'CONFIRMED' AND install_id = 3",
)
def list_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = star(*_all(spark, sf_dir)).where("status = 'CONFIRMED' AND install_id = 3").withColumn("start", primary())
    return rows.select("event_id", F.row_number().over(Window.partitionBy("install_id").orderBy(F.col("start").asc_nulls_last(), "event_id")).cast("bigint").alias("place"))


@query(
    "calendar_recent",
    """SELECT event_id, updated_on FROM (SELECT * FROM release_events WHERE NOT archived ORDER BY updated_on DESC, event_id LIMIT 20)
    WHERE event_id NOT IN (SELECT target_id FROM reactions WHERE user_id = 7)""", days=("updated_on",))
def recent(spark, sf_dir):
    """The limit comes before the exclusions, so fewer than 20 may be left."""
    last = d.release_events(spark, sf_dir).where("NOT archived").orderBy(F.col("updated_on").desc(), "event_id").limit(20)
    gone = d.reactions(spark, sf_dir).where("user_id = 7").select(F.col("target_id").alias("event_id"))
    return last.join(gone, "event_id", "left_anti").select("event_id", "updated_on")


@query("calendar_not_dismissed", "SELECT event_id FROM release_events WHERE type = 'SHELF' AND event_id NOT IN (SELECT target_id FROM (SELECT user_id, target_id, arg_max(emoji, (ts, event_id)) AS emoji FROM reactions GROUP BY ALL) WHERE emoji = 'angry')")
def not_dismissed(spark, sf_dir):
    """Events that no user's last reaction dismisses."""
    last = d.reactions(spark, sf_dir).groupBy("user_id", "target_id").agg(F.max_by("emoji", F.struct("ts", "event_id")).alias("emoji"))
    gone = last.where("emoji = 'angry'").select(F.col("target_id").alias("event_id"))
    return d.release_events(spark, sf_dir).where("type = 'SHELF'").join(gone, "event_id", "left_anti").select("event_id")


@query(
    "calendar_soonest_per_set",
    """SELECT set_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY date_exact NULLS FIRST, date_start NULLS FIRST, window_start NULLS FIRST, event_id) AS n
    FROM release_events WHERE NOT archived AND kind <> 'TBD') WHERE n = 1""",
)
def soonest(spark, sf_dir):
    """Days come after ranges and windows here, since unknown days sort first."""
    order = [F.col(c).asc_nulls_first() for c in ("date_exact", "date_start", "window_start")] + [F.col("event_id")]
    return top_by(d.release_events(spark, sf_dir).where("NOT archived AND kind <> 'TBD'"), ["set_id"], order).select("set_id", "event_id")


@query(
    "calendar_wording",
    """SELECT event_id, CASE kind WHEN 'EXACT' THEN strftime(date_exact, '%b %-d, %Y') WHEN 'RANGE' THEN strftime(date_start, '%b %-d, %Y') || ' – ' || strftime(date_end, '%b %-d, %Y')
    WHEN 'WINDOW' THEN strftime(window_start, '%B %Y') ELSE 'Date unconfirmed' END AS said FROM release_events""",
)
def said(spark, sf_dir):
    return d.release_events(spark, sf_dir).select("event_id", wording().alias("said"))


@query(
    "calendar_titles",
    """SELECT event_id, coalesce(name, code, 'Untitled') || CASE type WHEN 'PRERELEASE' THEN ' (Prerelease)' WHEN 'PROMO' THEN ' (Promo)' ELSE '' END AS title,
    CASE region WHEN 'GLOBAL' THEN NULL WHEN 'NA' THEN 'North America' WHEN 'EU' THEN 'Europe' WHEN 'APAC' THEN 'Asia-Pacific' ELSE 'Other' END AS badge
    FROM release_events JOIN product_sets USING (set_id)""",
)
def titles(spark, sf_dir):
    suffix = F.when(F.col("type") == "PRERELEASE", " (Prerelease)").when(F.col("type") == "PROMO", " (Promo)").otherwise("")
    badge = F.create_map(*[F.lit(x) for x in ("NA", "North America", "EU", "Europe", "APAC", "Asia-Pacific", "OTHER", "Other")])
    rows = d.release_events(spark, sf_dir).join(d.product_sets(spark, sf_dir), "set_id")
    return rows.select("event_id", F.concat(F.coalesce("name", "code", F.lit("Untitled")), suffix).alias("title"), F.try_element_at(badge, F.col("region")).alias("badge"))


@query(
    "set_page",
    """SELECT set_id, slug, name, count(*) AS events, CAST(sum(n) AS BIGINT) AS claims FROM release_events JOIN product_sets USING (set_id) JOIN installs USING (install_id)
    JOIN (SELECT event_id, count(*) AS n FROM claims GROUP BY event_id) USING (event_id) WHERE enabled AND NOT archived GROUP BY set_id, slug, name""",
)
def set_page(spark, sf_dir):
    events, sets, installs = _all(spark, sf_dir)
    n = d.claims(spark, sf_dir).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    rows = star(events, sets, installs).where("enabled AND NOT archived").join(n, "event_id")
    return rows.groupBy("set_id", "slug", "name").agg(F.count(F.lit(1)).alias("events"), F.sum("n").alias("claims"))


@query("tracked_events", "SELECT event_id FROM release_events e WHERE NOT archived AND EXISTS (SELECT 1 FROM claims c WHERE c.event_id = e.event_id AND live)")
def tracked(spark, sf_dir):
    return d.release_events(spark, sf_dir).where("NOT archived").join(d.claims(spark, sf_dir).where("live"), "event_id", "left_semi").select("event_id")


@query("untouched_events", "SELECT event_id FROM release_events e WHERE NOT archived AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.event_id = e.event_id AND live)")
def untouched(spark, sf_dir):
    return d.release_events(spark, sf_dir).where("NOT archived").join(d.claims(spark, sf_dir).where("live"), "event_id", "left_anti").select("event_id")


@query("past_events", "SELECT event_id, kind FROM release_events WHERE kind IN ('EXACT', 'RANGE') AND coalesce(date_exact, date_end) + 1 <= DATE '1998-01-01'")
def past(spark, sf_dir):
    return d.release_events(spark, sf_dir).where(is_past(F.lit("1998-01-01").cast("date"))).select("event_id", "kind")


@query("forward_window", "SELECT event_id FROM release_events WHERE kind = 'TBD' OR coalesce(date_exact, date_start, window_start) >= DATE '2001-06-01' - 90")
def forward(spark, sf_dir):
    return d.release_events(spark, sf_dir).where((F.col("kind") == "TBD") | (primary() >= F.date_sub(F.lit("2001-06-01").cast("date"), 90))).select("event_id")


@query(
    "digest_upcoming",
    f"""SELECT user_id, count(DISTINCT event_id) AS events, min(coalesce(date_exact, date_start, window_start)) AS first_day FROM subscriptions JOIN product_sets USING (install_id) JOIN release_events USING (set_id)
    WHERE premium AND alerts AND NOT archived AND {_OVER.format("1999-05-01", "1999-05-14")} GROUP BY user_id""", days=("first_day",))
def digest(spark, sf_dir):
    """Events of an install are gathered once and then meet its subscribers, one row per user."""
    events = d.release_events(spark, sf_dir).where(~F.col("archived") & overlaps("1999-05-01", "1999-05-14")).join(d.product_sets(spark, sf_dir), "set_id")
    per_install = events.groupBy("install_id").agg(F.countDistinct("event_id").alias("events"), F.min(primary()).alias("first_day"))
    return d.subscriptions(spark, sf_dir).where("premium AND alerts").join(per_install, "install_id").select("user_id", "events", "first_day")


@query(
    "lead_time_reminders",
    "SELECT user_id, event_id FROM subscriptions JOIN product_sets USING (install_id) JOIN release_events USING (set_id) WHERE alerts AND date_exact = DATE '1998-04-01' + CASE WHEN premium THEN 7 ELSE 3 END",
)
def reminders(spark, sf_dir):
    """Every subscriber with alerts: premium ones a week before, others three days."""
    due = d.release_events(spark, sf_dir).join(d.product_sets(spark, sf_dir), "set_id").select("install_id", "event_id", "date_exact")
    users = d.subscriptions(spark, sf_dir).where("alerts").select("install_id", "user_id", F.date_add(F.lit("1998-04-01").cast("date"), F.when(F.col("premium"), 7).otherwise(3)).alias("date_exact"))
    return users.join(due, ["install_id", "date_exact"]).select("user_id", "event_id")


@query(
    "lead_time_reminders_all",
    "SELECT user_id, event_id FROM subscriptions JOIN product_sets USING (install_id) JOIN release_events USING (set_id) WHERE premium AND alerts AND date_exact = DATE '1998-04-01' + CAST(user_id % 14 + 1 AS INTEGER)",
)
def all_reminders(spark, sf_dir):
    """Every premium subscriber with alerts, each with their own number of days, 1 to 14."""
    due = d.release_events(spark, sf_dir).join(d.product_sets(spark, sf_dir), "set_id").select("install_id", "event_id", "date_exact")
    users = d.subscriptions(spark, sf_dir).where("premium AND alerts").select("install_id", "user_id", F.expr("date_add(DATE '1998-04-01', CAST(user_id % 14 + 1 AS INT))").alias("date_exact"))
    return users.join(due, ["install_id", "date_exact"]).select("user_id", "event_id")


@query(
    "notification_fan_out",
    """SELECT event_id, count(*) AS recipients FROM (
      SELECT event_id, user_id FROM release_events JOIN product_sets USING (set_id) JOIN subscriptions USING (install_id) WHERE alerts AND updated_on = DATE '1999-02-03'
      UNION SELECT event_id, user_id FROM release_events JOIN (SELECT target_id AS event_id, user_id FROM reactions WHERE emoji = 'love') USING (event_id) WHERE updated_on = DATE '1999-02-03') GROUP BY event_id""",
)
def fan_out(spark, sf_dir):
    changes = d.release_events(spark, sf_dir).where(F.col("updated_on") == F.lit("1999-02-03").cast("date")).select("event_id", "set_id")
    followed = changes.join(d.product_sets(spark, sf_dir).select("set_id", "install_id"), "set_id").select("event_id", "install_id")
    loved = changes.join(d.reactions(spark, sf_dir).where("emoji = 'love'").select(F.col("target_id").alias("event_id"), "user_id"), "event_id").select("event_id", "user_id")
    return recipients(followed, d.subscriptions(spark, sf_dir).where("alerts").select("install_id", "user_id"), loved)


@query(
    "sitemap",
    """SELECT '/' AS path, CAST(NULL AS DATE) AS modified UNION ALL SELECT '/calendar', NULL UNION ALL SELECT '/calendar/' || slug, NULL FROM installs WHERE enabled
    UNION ALL SELECT '/calendar/' || slug || '/' || set_id, max(updated_on) FROM release_events JOIN product_sets USING (set_id) JOIN installs USING (install_id) WHERE enabled GROUP BY slug, set_id""", days=("modified",))
def sitemap(spark, sf_dir):
    events, sets, installs = _all(spark, sf_dir)
    none = F.lit(None).cast("date").alias("modified")
    fixed = spark.createDataFrame([("/",), ("/calendar",)], "path string").select("path", none)
    games = installs.where("enabled").select(F.concat(F.lit("/calendar/"), "slug").alias("path"), none)
    pages = star(events, sets, installs).where("enabled").groupBy("slug", "set_id").agg(F.max("updated_on").alias("modified"))
    return fixed.unionByName(games).unionByName(pages.select(F.concat(F.lit("/calendar/"), "slug", F.lit("/"), F.col("set_id").cast("string")).alias("path"), "modified"))
