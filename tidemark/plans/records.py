"""Stored records as snapshots: reviews, payloads, runs, notes, comments, settings, claims and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import synthetic_code
from tidemark.operators import records, snapshots
from tidemark.operators.gate import diff, evaluate
from tidemark.plans.base import query
from tidemark.plans.decisions import NOW, _gate_sql, gate_inputs
from tidemark.sources import domain as d

_REASONS = "CASE CAST(l_suppkey % 3 AS INTEGER) WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'LARGE_SHIFT' ELSE 'IDENTITY' END"


def _flags(spark, sf_dir):
    """Flags of events by reason: one for each claim, its run as the detail."""
    rows = d.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), d.pick(F.col("l_suppkey") % 3, "CONFLICT", "LARGE_SHIFT", "IDENTITY").alias("reason"), F.col("l_linenumber").alias("run"))
    return rows


@query("reviews_opened", f"WITH f AS (SELECT l_orderkey AS event_id, {_REASONS} AS reason, l_linenumber AS run FROM lineitem), o AS (SELECT event_id, reason, max(run) AS detail, event_id % 4 = 0 AS resolved FROM f WHERE run <= 2 GROUP BY ALL), n AS (SELECT event_id, reason, max(run) AS detail FROM f WHERE run > 2 GROUP BY ALL) SELECT o.event_id, o.reason, CASE WHEN NOT o.resolved AND n.detail IS NOT NULL THEN n.detail ELSE o.detail END AS detail, o.resolved FROM o LEFT JOIN n USING (event_id, reason) UNION ALL SELECT event_id, reason, detail, FALSE FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.event_id = n.event_id AND o.reason = n.reason AND NOT o.resolved)")
def reviews_opened(spark, sf_dir):
    """The first two runs' flags are the stored items, of which some are resolved; later flags refresh the open one or open a new one."""
    flags = _flags(spark, sf_dir)
    last = lambda rows: rows.groupBy("event_id", "reason").agg(F.max("run").alias("detail"))
    stored = last(flags.where("run <= 2")).withColumn("resolved", F.col("event_id") % 4 == 0)
    return records.open_reviews(stored, last(flags.where("run > 2")))


@query("reviews_resolved", "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 0 THEN TRUE ELSE is_override END AS is_override, CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 0 THEN updated_on ELSE date_exact END AS date_exact, CASE event_id % 4 WHEN 0 THEN 'earlier' ELSE CASE event_id % 3 WHEN 0 THEN 'Accepted day' WHEN 1 THEN 'Kept the currently published date' ELSE 'Dismissed' END END AS note FROM release_events WHERE kind = 'EXACT' OR event_id % 4 <> 0", days=("date_exact",))
def reviews_resolved(spark, sf_dir):
    """An accepted day pins the event; an item that is resolved already stays as it was."""
    events = d.release_events(spark, sf_dir).where("kind = 'EXACT' OR event_id % 4 <> 0")
    items = events.select("event_id", F.when(F.expr("event_id % 4 = 0"), F.lit("earlier")).alias("resolved_note"))
    choice = d.pick(F.col("event_id") % 3, "accept", "keep", "dismiss")
    decisions = events.select("event_id", choice.alias("choice"), F.when(choice == "accept", F.col("updated_on")).alias("day"), F.lit(None).cast("string").alias("note"))
    pinned, noted = records.resolve_reviews(events, items, decisions)
    return pinned.select("event_id", "is_override", "date_exact").join(noted.select("event_id", F.col("resolved_note").alias("note")), "event_id")


@query("payload_cleanup", "SELECT run_id FROM provider_runs WHERE started_at >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY")
def payload_cleanup(spark, sf_dir):
    return records.younger_than(d.provider_runs(spark, sf_dir), "started_at", "2024-02-10 00:00:00", 30).select("run_id")


@query("archived_sets_purged", "SELECT set_id FROM product_sets WHERE NOT (set_id % 5 = 0 AND DATE '2024-01-01' + CAST(set_id % 60 AS INTEGER) < DATE '2024-02-10' - 30)")
def archived_sets_purged(spark, sf_dir):
    sets = d.product_sets(spark, sf_dir).withColumn("archived_at", F.when(F.expr("set_id % 5 = 0"), F.expr("cast(date_add(date'2024-01-01', cast(set_id % 60 as int)) as timestamp_ntz)")))
    return records.younger_than(sets, "archived_at", "2024-02-10 00:00:00", 30).select("set_id")


@query("provider_validators", "SELECT provider, arg_max(run_id, (started_at, run_id)) FILTER (status IN ('OK', 'DEGRADED')) AS run_id, max(started_at) FILTER (status IN ('OK', 'DEGRADED')) AS fetched_at FROM provider_runs GROUP BY provider HAVING count(*) FILTER (status IN ('OK', 'DEGRADED')) > 0")
def provider_validators(spark, sf_dir):
    """Only runs that brought a body write the provider's validator; the last one stands."""
    good = d.provider_runs(spark, sf_dir).where("status IN ('OK', 'DEGRADED')").select("provider", "run_id", F.col("started_at").alias("fetched_at"))
    last = snapshots.latest(good, ["provider"], ["fetched_at", "run_id"])
    return snapshots.upsert(last.where("provider < 3"), last, ["provider"])


@query("payloads_stored", "SELECT scan_id, provider, run_id, CASE WHEN status = 'OK' THEN value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, provider ORDER BY started_at DESC, run_id DESC) AS r FROM provider_runs) WHERE r = 1")
def payloads_stored(spark, sf_dir):
    """A payload of a run and provider replaces the one before, body and all, also by an empty one."""
    rows = d.provider_runs(spark, sf_dir).select("scan_id", "provider", "run_id", "started_at", F.when(F.col("status") == "OK", F.col("value")).alias("value"))
    keys, order = ["scan_id", "provider"], ["started_at", "run_id"]
    early = "started_at < timestamp_ntz'2024-01-20 00:00:00'"
    return snapshots.upsert(snapshots.latest(rows.where(early), keys, order), snapshots.latest(rows.where(f"NOT ({early})"), keys, order), keys).drop("started_at")


@query("runs_finalised", "SELECT scan_id, count(*) AS providers, CASE WHEN count(*) FILTER (status = 'FAILED') = count(*) THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, '{\"providers\":' || count(*) || ',\"failed\":' || count(*) FILTER (status = 'FAILED') || '}' AS totals FROM provider_runs GROUP BY scan_id")
def runs_finalised(spark, sf_dir):
    """A run is created as running and finalised with totals, as JSON."""
    runs = d.provider_runs(spark, sf_dir)
    created = runs.select("scan_id").distinct().withColumns({"status": F.lit("RUNNING"), "totals": F.lit(None).cast("string")})
    failed = F.count_if(F.col("status") == "FAILED")
    done = runs.groupBy("scan_id").agg(F.count(F.lit(1)).alias("providers"), failed.alias("failed"))
    ended = done.select("scan_id", "providers", F.when(F.col("failed") == F.col("providers"), "FAILED").otherwise("SUCCEEDED").alias("_status"), F.to_json(F.struct("providers", "failed")).alias("_totals"))
    return created.join(ended, "scan_id", "left").select("scan_id", "providers", F.coalesce("_status", "status").alias("status"), F.coalesce("_totals", "totals").alias("totals"))


@query("notes_saved", "SELECT user_id, target_id, 'note ' || event_id AS note FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target_id ORDER BY ts DESC, event_id DESC) AS r FROM reactions) WHERE r = 1 AND event_id % 4 <> 0")
def notes_saved(spark, sf_dir):
    """The last text of each user and target; an empty one deletes the note."""
    log = d.reactions(spark, sf_dir).select("user_id", "target_id", "ts", "event_id", F.when(F.expr("event_id % 4 = 0"), F.lit("  ")).otherwise(F.concat(F.lit("note "), "event_id")).alias("note"))
    return records.fold(log, ["user_id", "target_id"], ["ts", "event_id"], ["note"], F.trim("note") != "")


@query("toggles_folded", "SELECT user_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target_id ORDER BY ts DESC, event_id DESC) AS r FROM reactions) WHERE r = 1 AND emoji IN ('like', 'love', 'wow')")
def toggles_folded(spark, sf_dir):
    """Follow and unfollow, subscribe, dismiss: the last action of each pair tells whether the row is there."""
    log = d.reactions(spark, sf_dir).withColumn("on", F.col("emoji").isin("like", "love", "wow"))
    return records.fold(log, ["user_id", "target_id"], ["ts", "event_id"], ["on"], F.col("on")).select("user_id", "target_id")


@query("comments_kept", "SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 1 UNION ALL SELECT conv_id, turn + 1000 FROM conversations WHERE turn = 0")
def comments_kept(spark, sf_dir):
    """Some comments are deleted by id, others come in."""
    rows = d.read(spark, sf_dir, "conversations").select("conv_id", "turn")
    new = rows.where("turn = 0").withColumn("turn", F.col("turn") + 1000)
    return records.delete_insert(rows, rows.where("turn % 3 = 1"), new, ["conv_id", "turn"])


@query("installs_seeded", "SELECT install_id, code FROM (SELECT install_id, 'PLACEHOLDER-' || install_id AS code FROM installs WHERE install_id IN (3, 4) AND install_id NOT IN (SELECT install_id FROM product_sets WHERE install_id <> 4)) UNION ALL SELECT install_id, code FROM product_sets WHERE install_id <> 4")
def installs_seeded(spark, sf_dir):
    """Two installs are enabled; the one without sets gets a placeholder."""
    sets = d.product_sets(spark, sf_dir).where("install_id <> 4").select("install_id", "code")
    enabled = d.installs(spark, sf_dir).where("install_id IN (3, 4)").select(F.col("install_id").cast("int").alias("install_id"))
    empty = enabled.join(sets.select("install_id").distinct(), "install_id", "left_anti")
    return sets.unionByName(empty.withColumn("code", F.concat(F.lit("PLACEHOLDER-"), "install_id")))


@query("user_settings", "SELECT user_id, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 < 3 THEN 'Europe/Berlin' ELSE 'UTC' END AS timezone, CASE WHEN user_id % 5 = 0 THEN NOT alerts ELSE alerts END AS alerts, CASE WHEN user_id % 11 = 0 THEN TRUE ELSE premium END AS premium, CASE WHEN user_id % 13 = 0 THEN sha256(CAST(user_id AS VARCHAR) || '|2') ELSE sha256(CAST(user_id AS VARCHAR) || '|1') END AS token FROM subscriptions")
def user_settings(spark, sf_dir):
    """Setters of a profile: time zone (also cleared), alerts, role, and a calendar token that is rotated."""
    token = lambda n: F.sha2(F.concat(F.col("user_id").cast("string"), F.lit(f"|{n}")), 256)
    users = d.subscriptions(spark, sf_dir).select("user_id", F.lit("UTC").alias("timezone"), "alerts", "premium", token(1).alias("token"))
    when = lambda c, v: F.when(F.expr(c), v)
    changes = users.select(
        "user_id", when("user_id % 7 IN (1, 2)", F.lit("Europe/Berlin")).alias("timezone"), F.expr("user_id % 7 < 3").alias("set_timezone"), (~F.col("alerts")).alias("alerts"), F.expr("user_id % 5 = 0").alias("set_alerts"),
        F.lit(True).alias("premium"), F.expr("user_id % 11 = 0").alias("set_premium"), token(2).alias("token"), F.expr("user_id % 13 = 0").alias("set_token"),
    )
    return snapshots.patch(users, changes, ["user_id"], ["timezone", "alerts", "premium", "token"])


@query("feeds_switched", "SELECT source, source NOT IN ('src1', 'src3') AS enabled FROM (SELECT DISTINCT source FROM documents)")
def feeds_switched(spark, sf_dir):
    """Feeds are switched on and off by key; a switch of an unknown one changes nothing."""
    feeds = d.read(spark, sf_dir, "documents").select("source").distinct().withColumn("enabled", F.lit(True))
    switched = spark.createDataFrame([("src1", False, True), ("src3", False, True), ("nowhere", False, True)], "source string, enabled boolean, set_enabled boolean")
    return snapshots.patch(feeds, switched, ["source"], ["enabled"])


@query("account_states", "SELECT user_id, CASE WHEN banned THEN 'BANNED' WHEN scheduled AND NOT cancelled THEN 'REMOVAL' ELSE 'ACTIVE' END AS state, CASE WHEN scheduled AND NOT cancelled AND NOT banned THEN DATE '2024-01-01' + 30 END AS removal_on FROM (SELECT c_custkey AS user_id, c_custkey % 3 = 0 AS scheduled, c_custkey % 6 = 0 AS cancelled, c_custkey % 5 = 0 AND c_custkey % 10 <> 0 AS banned FROM customer)", days=("removal_on",))
def account_states(spark, sf_dir):
    """Transitions in order: removal scheduled, cancelled, ban, unban. A ban takes a scheduled removal's place."""
    users = d.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    step = lambda n, action, where: users.where(where).select("user_id", F.lit(n).alias("at"), F.lit(action).alias("action"), F.lit("2024-01-01").cast("date").alias("on"))
    log = step(1, "schedule", "user_id % 3 = 0").union(step(2, "cancel", "user_id % 6 = 0")).union(step(3, "ban", "user_id % 5 = 0")).union(step(4, "unban", "user_id % 10 = 0"))
    return records.account_states(users, log, 30)


@query("claim_dates_folded", "SELECT event_id, CASE WHEN kind = 'EXACT' THEN date_exact END AS date_exact, coalesce(date_start, window_start) AS date_start, coalesce(date_end, window_end) AS date_end FROM release_events", days=("date_exact", "date_start", "date_end"))
def claim_dates_folded(spark, sf_dir):
    """A stored claim has no window: its bounds become those of a range."""
    return records.claim_dates(d.release_events(spark, sf_dir)).select("event_id", "date_exact", "date_start", "date_end")


@query("events_created", "WITH k AS (SELECT DISTINCT set_id, type, region FROM release_events UNION SELECT set_id, 'SPECIAL', 'JP' FROM product_sets WHERE set_id % 10 = 0), e AS (SELECT set_id, type, region, min(event_id) AS event_id FROM release_events WHERE NOT archived AND event_id % 19 <> 0 GROUP BY ALL) SELECT set_id, type, region, CAST(event_id AS VARCHAR) AS event_id, event_id IS NULL AS created, CASE WHEN event_id IS NULL THEN 'TBD' END AS kind FROM k LEFT JOIN e USING (set_id, type, region)")
def events_created(spark, sf_dir):
    """For each key the oldest live event that is not derived, or a new one without a date."""
    events = d.release_events(spark, sf_dir).withColumn("derived", F.col("event_id") % 19 == 0)
    special = d.product_sets(spark, sf_dir).where("set_id % 10 = 0").select("set_id", F.lit("SPECIAL").alias("type"), F.lit("JP").alias("region"))
    wanted = events.select("set_id", "type", "region").union(special).distinct()
    return records.find_or_create(wanted, events).select("set_id", "type", "region", F.when(~F.col("created"), F.col("event_id")).alias("event_id"), "created", F.when(F.col("created"), F.lit("TBD")).alias("kind"))


@query("verdicts_applied", "SELECT event_id, CASE WHEN is_override THEN date_exact ELSE coalesce(c.day, date_exact) END AS day, CASE WHEN c.day IS NOT NULL THEN 'CONFIRMED' ELSE status END AS status, coalesce(c.day, updated_on) AS last_seen FROM release_events LEFT JOIN (SELECT event_id, max(claim_date) AS day FROM claims WHERE live GROUP BY event_id) c USING (event_id)", days=("day", "last_seen"))
def verdicts_applied(spark, sf_dir):
    """Status always, dates unless pinned by hand, the time of last sight only where something was seen."""
    seen = d.claims(spark, sf_dir).where("live").groupBy("event_id").agg(F.max("claim_date").alias("day")).withColumns({"new_status": F.lit("CONFIRMED"), "seen_on": F.col("day")})
    events = d.release_events(spark, sf_dir).select("event_id", F.col("date_exact").alias("day"), "status", "is_override", F.col("updated_on").alias("last_seen"))
    return records.apply_verdicts(events, seen).select("event_id", "day", "status", "last_seen")


@query("run_diff_saved", "SELECT run, count(*) AS changes, count(*) AS stored FROM (SELECT l_linenumber AS run, l_orderkey FROM lineitem WHERE l_returnflag = 'N') GROUP BY run")
def run_diff_saved(spark, sf_dir):
    """A run's changes are JSON lists, one for each range of events; the same run saved again has them once, and read back they name each changed event of the run."""
    part = F.expr("event_id div 10000").alias("part")
    live = d.claims(spark, sf_dir).where("live")
    changes = live.groupBy("run", part).agg(F.to_json(F.array_sort(F.collect_list("event_id"))).alias("list"))
    saved = snapshots.upsert(changes, changes, ["run", "part"]).select("run", F.explode(F.from_json("list", "array<bigint>")).alias("event_id"))
    stored = saved.join(live.select("run", "event_id").distinct(), ["run", "event_id"], "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("stored"))
    return live.groupBy("run").agg(F.count(F.lit(1)).alias("changes")).join(stored, "run")


@query("sets_enriched", "SELECT set_id, CASE WHEN set_id % 2 = 0 THEN 'own.jpg' ELSE 'found' || lo || '.jpg' END AS image_url, CASE WHEN set_id % 2 = 1 THEN CASE WHEN lo IS NOT NULL THEN 'ART' END WHEN set_id % 4 = 0 THEN 'SYMBOL' WHEN lo IS NOT NULL AND set_id % 3 = 0 THEN 'ART' END AS image_kind, CASE WHEN set_id % 5 = 0 THEN 'own text' ELSE 'text ' || lo END AS description, coalesce('kind ' || hi, 'old') AS kind FROM product_sets LEFT JOIN (SELECT ref AS set_id, min(run) AS lo, max(run) AS hi FROM claims GROUP BY ref) USING (set_id)")
def sets_enriched(spark, sf_dir):
    """Images and texts fill what is missing, first come first; an image's kind only if it is of the stored image; the product's kind follows the provider."""
    null = F.lit(None).cast("string")
    sets = d.product_sets(spark, sf_dir).select("set_id", F.when(F.expr("set_id % 2 = 0"), F.lit("own.jpg")).alias("image_url"), F.when(F.expr("set_id % 4 = 0"), F.lit("SYMBOL")).alias("image_kind"), F.when(F.expr("set_id % 5 = 0"), F.lit("own text")).alias("description"), F.lit("old").alias("kind"))
    seen = d.claims(spark, sf_dir).groupBy(F.col("ref").alias("set_id"), "run").agg(F.count(F.lit(1)).alias("n"))
    url = F.when(F.expr("set_id % 6 = 0"), F.lit("own.jpg")).otherwise(F.concat(F.lit("found"), "run", F.lit(".jpg")))
    found = seen.select("set_id", F.col("run").alias("place"), url.alias("image_url"), F.lit("ART").alias("image_kind"), F.concat(F.lit("text "), "run").alias("description"), F.concat(F.lit("kind "), "run").alias("kind"))
    return records.enrich(sets, found.withColumn("image_kind", F.coalesce("image_kind", null)))


@query("sets_created", "SELECT name, first, CASE WHEN first % 3 = 0 OR n > 1 THEN 'SYN-' || substr(replace(upper(name), ' ', '-'), 1, 24) || '-' || upper(substr(sha256(name), 1, 6)) ELSE code END AS code, first % 3 = 0 OR n > 1 AS synthetic FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM (SELECT name, min(set_id) AS first, arg_min(code, set_id) AS code FROM product_sets GROUP BY name))")
def sets_created(spark, sf_dir):
    """New sets by name; without a code, or with one that others have too, the code is made up from the name."""
    new = d.product_sets(spark, sf_dir).groupBy("name").agg(F.min("set_id").alias("first"), F.min_by("code", "set_id").alias("code"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("code")) > 1
    made = new.withColumn("synthetic", (F.col("first") % 3 == 0) | shared)
    return made.select("name", "first", F.when(F.col("synthetic"), synthetic_code(F.col("name"))).otherwise(F.col("code")).alias("code"), "synthetic")


@query("failed_retried", "WITH l AS (SELECT scan_id, provider, arg_max(status, (started_at, run_id)) AS status FROM provider_runs GROUP BY ALL) SELECT scan_id, provider, CASE WHEN status = 'FAILED' AND provider % 2 = 0 THEN 'OK' ELSE status END AS status, status = 'FAILED' AS retried, status = 'FAILED' AND provider % 2 <> 0 AS still_failing FROM l")
def failed_retried(spark, sf_dir):
    """Only a run's failed providers are fetched again; what comes back is merged into the same run."""
    runs = d.provider_runs(spark, sf_dir).groupBy("scan_id", "provider").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("status"))
    again = runs.where("status = 'FAILED'").select("scan_id", "provider", F.when(F.expr("provider % 2 = 0"), F.lit("OK")).otherwise(F.lit("FAILED")).alias("status"))
    return records.retry(runs, again)


@query("failed_providers_last", "SELECT scan_id, provider FROM (SELECT scan_id, provider, arg_max(status, (started_at, run_id)) AS status FROM provider_runs GROUP BY ALL) WHERE status = 'FAILED'")
def failed_providers_last(spark, sf_dir):
    """Providers of a run whose last attempt failed."""
    runs = d.provider_runs(spark, sf_dir).groupBy("scan_id", "provider").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("status"))
    return runs.where("status = 'FAILED'").select("scan_id", "provider")


@query("alarms_raised", "WITH s AS (SELECT provider, max(started_at) FILTER (status = 'OK' AND value < 0.5) AS ok, min(started_at) AS first FROM provider_runs GROUP BY provider), a AS (SELECT provider, coalesce(ok, first) AS since FROM s) SELECT provider, CASE WHEN since <= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 48 HOUR THEN CASE WHEN provider % 3 = 0 THEN 'RAISE' WHEN provider % 3 = 1 THEN 'KEEP' ELSE 'REPEAT' END WHEN provider % 3 <> 0 THEN 'CLEAR' ELSE 'NONE' END AS action, CASE WHEN since <= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 48 HOUR THEN CASE WHEN provider % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-01-25 00:00:00' END END AS opened_at FROM a")
def alarms_raised(spark, sf_dir):
    """Stale providers raise an alarm, again after a day, and the first time of it stays; fresh ones clear theirs."""
    runs = d.provider_runs(spark, sf_dir)
    seen = runs.groupBy("provider").agg(F.max(F.when(F.expr("status = 'OK' AND value < 0.5"), F.col("started_at"))).alias("ok"), F.min("started_at").alias("first")).select("provider", F.coalesce("ok", "first").alias("since"))
    at = lambda x: F.to_timestamp_ntz(F.lit(x))
    notified = F.when(F.col("provider") % 3 == 1, at("2024-01-31 12:00:00")).otherwise(at("2024-01-30 12:00:00"))
    alarms = seen.where("provider % 3 <> 0").select("provider", at("2024-01-25 00:00:00").alias("opened_at"), notified.alias("notified_at"))
    return records.alarms(seen, alarms, "2024-02-01 00:00:00").select("provider", "action", "opened_at")


@query("shelf_first", "WITH s AS (SELECT set_id, region, max(event_id) AS event_id FROM release_events WHERE type = 'SHELF' AND NOT archived GROUP BY ALL), a AS (SELECT s.set_id, s.region, CASE WHEN e.event_id % 2 = 0 THEN 'CONFIRMED' ELSE e.status END AS status, CASE WHEN e.event_id % 2 = 0 THEN e.updated_on ELSE e.date_exact END AS day FROM s JOIN release_events e USING (event_id)) SELECT e.event_id, CAST(CASE WHEN e.type = 'SHELF' THEN 1 ELSE 2 END AS INTEGER) AS pass, CASE WHEN e.type <> 'SHELF' AND a.status IN ('CONFIRMED', 'RELEASED') THEN a.day END AS anchor FROM release_events e LEFT JOIN a ON a.set_id = e.set_id AND a.region = e.region WHERE NOT e.archived", days=("anchor",))
def shelf_first(spark, sf_dir):
    """Shelf groups are decided first; what this run decided lies over the stored anchors that prerelease groups are checked against."""
    events = d.release_events(spark, sf_dir).where("NOT archived")
    shelf = events.where("type = 'SHELF'")
    stored = shelf.groupBy("set_id", "region").agg(F.max_by(F.struct("event_id", "status", F.col("date_exact").alias("day"), "updated_on"), "event_id").alias("x")).select("set_id", "region", "x.*")
    decided = stored.where("event_id % 2 = 0").select("set_id", "region", F.lit("CONFIRMED").alias("status"), F.col("updated_on").alias("day"))
    anchors = records.overlaid(stored.select("set_id", "region", "status", "day"), decided, ["set_id", "region"])
    open_ = F.col("status").isin("CONFIRMED", "RELEASED") & (F.col("type") != "SHELF")
    met = events.select("event_id", "type", "set_id", "region").join(anchors, ["set_id", "region"], "left")
    return met.select("event_id", F.when(F.col("type") == "SHELF", 1).otherwise(2).alias("pass"), F.when(open_, F.col("day")).alias("anchor"))


@query("verdict_reviews", f"SELECT v.event_id, v.reason, CAST(row_number() OVER (PARTITION BY v.event_id ORDER BY origin, run, ref, claim_date) - 1 AS INTEGER) AS place, origin, claim_date AS day FROM ({_gate_sql(3, 14, False, 'event_id, action, reason')}) v JOIN claims USING (event_id) WHERE action = 'FLAG' AND live", days=("day",))
def verdict_reviews(spark, sf_dir):
    """The review queue from real verdicts of all events: each live claim of a flagged event with its index."""
    claims, published = gate_inputs(spark, sf_dir)
    claims = claims.drop("place")  # no weight counts here
    flagged = evaluate(claims, published, NOW).where("action = 'FLAG'").select("event_id", "reason")
    entries = claims.where("live").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("origin", "seq", "day"))).alias("claims"))
    return flagged.join(entries, "event_id").select("event_id", "reason", F.posexplode("claims").alias("place", "c")).select("event_id", "reason", "place", "c.origin", "c.day")


@query("verdict_notices", f"SELECT CASE WHEN pub_status IS NULL THEN 'created' WHEN status = 'RELEASED' AND pub_status <> 'RELEASED' THEN 'released' WHEN status <> pub_status THEN 'status_changed' END AS notice, count(*) AS n FROM ({_gate_sql(3, 14, False, '*')}) v WHERE day IS DISTINCT FROM pub_day OR status IS DISTINCT FROM pub_status GROUP BY 1")
def verdict_notices(spark, sf_dir):
    """Notices by kind that the diff of all events makes."""
    claims, published = gate_inputs(spark, sf_dir)
    return diff(evaluate(claims, published, NOW), published).groupBy("notice").agg(F.count(F.lit(1)).alias("n"))
