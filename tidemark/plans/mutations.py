"""Mutations over the domain's tables: old snapshot and changes in, new snapshot out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import snapshots
from tidemark.plans.base import query
from tidemark.schema import RETENTION_FLOOR_DAYS
from tidemark.sources import domain as d


@query("upsert_runs", "SELECT provider, scan_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY provider, scan_id ORDER BY started_at DESC, run_id DESC) AS r FROM provider_runs) WHERE r = 1")
def upsert_runs(spark, sf_dir):
    """Old runs, then the newer half of the table on top."""
    runs = d.provider_runs(spark, sf_dir).select("provider", "scan_id", "run_id", "status", "started_at")
    last = lambda half: snapshots.latest(runs.where(half), ["provider", "scan_id"], ["started_at", "run_id"])
    middle = "started_at >= timestamp_ntz'2024-01-15 00:00:00'"
    return snapshots.upsert(last(f"NOT ({middle})"), last(middle), ["provider", "scan_id"]).select("provider", "scan_id", "run_id", "status")


@query("first_pin_wins", "SELECT origin, ref, event_id FROM (SELECT *, row_number() OVER (PARTITION BY origin, ref ORDER BY live, event_id) AS r FROM (SELECT DISTINCT origin, ref, event_id, live FROM claims)) WHERE r = 1")
def first_pin_wins(spark, sf_dir):
    """All claims: those no longer seen are the old pins, the ones seen now come after them."""
    pins = d.claims(spark, sf_dir).select("origin", "ref", "event_id", "live")
    part = lambda where: pins.where(where).drop("live").distinct()
    old = part("NOT live")
    return snapshots.insert_absent(snapshots.insert_absent(old.where("false"), old, ["origin", "ref"], ["event_id"]), part("live"), ["origin", "ref"], ["event_id"])


@query("first_pin_wins_all", "SELECT origin, ref, event_id FROM (SELECT *, row_number() OVER (PARTITION BY origin, ref ORDER BY later, event_id) AS r FROM (SELECT DISTINCT origin, ref, event_id, run > 1 AS later FROM claims)) WHERE r = 1")
def first_pin_wins_all(spark, sf_dir):
    """All claims: those of the first run are the old pins, all later runs bring new ones."""
    pins = d.claims(spark, sf_dir).select("origin", "ref", "event_id", "run")
    old = pins.where("run = 1").drop("run").distinct()
    first = snapshots.insert_absent(old.where("false"), old, ["origin", "ref"], ["event_id"])
    return snapshots.insert_absent(first, pins.where("run > 1").drop("run").distinct(), ["origin", "ref"], ["event_id"])


@query("claims_idempotent", "SELECT event_id, origin, run, claim_date, weight FROM (SELECT *, row_number() OVER (PARTITION BY event_id, origin, run ORDER BY ref DESC, claim_date DESC, weight DESC) AS r FROM claims) WHERE r = 1", days=("claim_date",))
def claims_idempotent(spark, sf_dir):
    """The same run written twice is written once; of an origin's two claims in a run the last stays."""
    rows = d.claims(spark, sf_dir).select("event_id", "origin", "run", "claim_date", "weight", "ref")
    keys = ["event_id", "origin", "run"]
    once = snapshots.latest(rows, keys, ["ref", "claim_date", "weight"])
    return snapshots.upsert(once, once, keys).drop("ref")


@query("find_or_create", "SELECT set_id, type, region, min(event_id) AS event_id, count(*) AS candidates FROM release_events WHERE NOT archived GROUP BY set_id, type, region")
def find_or_create(spark, sf_dir):
    """The oldest live event of each (set, type, region)."""
    return d.release_events(spark, sf_dir).where("NOT archived").groupBy("set_id", "type", "region").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("candidates"))


@query("conditional_update", "SELECT event_id, CASE WHEN is_override THEN updated_on ELSE coalesce(day, updated_on) END AS day FROM release_events LEFT JOIN (SELECT event_id, max(claim_date) AS day FROM claims WHERE live GROUP BY event_id) USING (event_id)", days=("day",))
def conditional_update(spark, sf_dir):
    """A day pinned by hand stays."""
    seen = d.claims(spark, sf_dir).where("live").groupBy("event_id").agg(F.max("claim_date").alias("_day"))
    rows = d.release_events(spark, sf_dir).join(seen, "event_id", "left")
    return rows.select("event_id", F.when(F.col("is_override"), F.col("updated_on")).otherwise(F.coalesce("_day", "updated_on")).alias("day"))


@query("enrich_null_only", "SELECT set_id, coalesce(CASE WHEN set_id % 2 = 0 THEN name END, found) AS image FROM product_sets LEFT JOIN (SELECT ref AS set_id, min(origin) AS found FROM claims GROUP BY ref) USING (set_id)")
def enrich(spark, sf_dir):
    sets = d.product_sets(spark, sf_dir).select("set_id", F.when(F.expr("set_id % 2 = 0"), F.col("name")).alias("image"))
    return snapshots.fill_null(sets, d.claims(spark, sf_dir).select(F.col("ref").alias("set_id"), F.col("origin").alias("image")), ["set_id"], ["image"])


@query("patch_tri_state", "SELECT set_id, CASE set_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'new' ELSE code END AS code FROM product_sets")
def patch(spark, sf_dir):
    sets = d.product_sets(spark, sf_dir).select("set_id", "code")
    changes = sets.select("set_id", F.when(F.expr("set_id % 3 = 1"), F.lit("new")).alias("code"), F.expr("set_id % 3 < 2").alias("set_code"))
    return snapshots.patch(sets, changes, ["set_id"], ["code"])


@query("retention", "SELECT event_id FROM release_events WHERE kind = 'TBD' OR coalesce(date_exact, date_end, window_end) >= DATE '1998-06-01' - 90")
def retention(spark, sf_dir):
    """Thirty days are asked for; the floor is ninety."""
    events = d.release_events(spark, sf_dir)
    return events.where(snapshots.retained(events, "1998-06-01", 30, RETENTION_FLOOR_DAYS)).select("event_id")


@query("cascade_delete", "SELECT (SELECT count(*) FROM product_sets WHERE install_id <> 2) AS sets, (SELECT count(*) FROM release_events WHERE set_id % 5 <> 2) AS events, (SELECT count(*) FROM claims WHERE event_id NOT IN (SELECT event_id FROM release_events WHERE set_id % 5 = 2)) AS claims")
def cascade(spark, sf_dir):
    tables = {"install": d.installs(spark, sf_dir), "set": d.product_sets(spark, sf_dir), "event": d.release_events(spark, sf_dir), "claim": d.claims(spark, sf_dir)}
    children = {"install": [("set", "install_id", "install_id")], "set": [("event", "set_id", "set_id")], "event": [("claim", "event_id", "event_id")]}
    left = snapshots.delete_cascade(tables, "install", tables["install"].where("install_id = 2").select("install_id"), children)
    one = lambda t, n: left[t].agg(F.count(F.lit(1)).alias(n))
    return one("set", "sets").crossJoin(one("event", "events")).crossJoin(one("claim", "claims"))


@query("billing_state", "SELECT user_id, emoji IN ('like', 'love') AS premium, n FROM (SELECT user_id, arg_max(emoji, (ts, event_id)) AS emoji, count(*) AS n FROM reactions GROUP BY user_id)")
def billing(spark, sf_dir):
    """The last event of each user decides; events of an earlier time change nothing, whatever order they come in."""
    return d.reactions(spark, sf_dir).groupBy("user_id").agg(F.max_by("emoji", F.struct("ts", "event_id")).isin("like", "love").alias("premium"), F.count(F.lit(1)).alias("n"))


@query("bulk_release", "SELECT event_id, CASE WHEN status IN ('ANNOUNCED', 'CONFIRMED') AND coalesce(date_exact, date_end) < DATE '1998-06-01' THEN 'RELEASED' ELSE status END AS status FROM release_events")
def bulk_release(spark, sf_dir):
    due = F.col("status").isin("ANNOUNCED", "CONFIRMED") & F.coalesce(F.coalesce("date_exact", "date_end") < F.lit("1998-06-01").cast("date"), F.lit(False))
    return d.release_events(spark, sf_dir).select("event_id", F.when(due, "RELEASED").otherwise(F.col("status")).alias("status"))
