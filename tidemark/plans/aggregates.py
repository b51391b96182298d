"""Aggregates, windows, top rows and set operations over runs, reactions, claims and news."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.dates import gap_days
from tidemark.operators.calendar import top_by
from tidemark.operators.claims import collapse_history, freshness, health, noisy_or, streaks
from tidemark.plans.base import query
from tidemark.sources import domain as d


@query(
    "provider_run_times",
    "SELECT provider, max(started_at) FILTER (status IN ('OK', 'NOT_MODIFIED')) AS last_ok_at, min(started_at) AS first_seen_at FROM provider_runs GROUP BY provider",
)
def run_times(spark, sf_dir):
    ok = F.col("status").isin("OK", "NOT_MODIFIED")
    return d.provider_runs(spark, sf_dir).groupBy("provider").agg(F.max(F.when(ok, F.col("started_at"))).alias("last_ok_at"), F.min("started_at").alias("first_seen_at"))


@query("reaction_counts", "SELECT target_id, emoji, count(*) AS n FROM reactions GROUP BY target_id, emoji")
def reaction_counts(spark, sf_dir):
    return d.reactions(spark, sf_dir).groupBy("target_id", "emoji").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reaction_scores",
    """SELECT target_id, CAST(sum(CASE WHEN emoji IN ('like', 'love') THEN 1 WHEN emoji IN ('sad', 'angry') THEN -1 ELSE 0 END) AS BIGINT) AS score FROM reactions
    GROUP BY target_id HAVING count(*) FILTER (emoji <> 'wow') > 0""",
)
def reaction_scores(spark, sf_dir):
    value = F.when(F.col("emoji").isin("like", "love"), 1).when(F.col("emoji").isin("sad", "angry"), -1)
    return d.reactions(spark, sf_dir).groupBy("target_id").agg(F.sum(value).alias("score")).where("score IS NOT NULL")


@query(
    "trending_top3",
    """SELECT target_id, score FROM (SELECT target_id, CAST(sum(CASE WHEN emoji IN ('like', 'love') THEN 1 WHEN emoji IN ('sad', 'angry') THEN -1 ELSE 0 END) AS BIGINT) AS score FROM reactions GROUP BY target_id)
    WHERE score > 0 ORDER BY score DESC, target_id LIMIT 3""",
)
def trending(spark, sf_dir):
    return reaction_scores(spark, sf_dir).where("score > 0").orderBy(F.col("score").desc(), "target_id").limit(3)


@query(
    "top_reactions",
    """SELECT target_id, emoji, n FROM (SELECT target_id, emoji, count(*) AS n, row_number() OVER (PARTITION BY target_id ORDER BY count(*) DESC, emoji) AS r FROM reactions GROUP BY target_id, emoji) WHERE r <= 2""",
)
def top_reactions(spark, sf_dir):
    return top_by(reaction_counts(spark, sf_dir), ["target_id"], [F.col("n").desc(), F.col("emoji")], 2)


@query(
    "reaction_latest",
    "SELECT user_id, target_id, emoji FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target_id ORDER BY ts DESC, event_id DESC) AS r FROM reactions) WHERE r = 1",
)
def reaction_latest(spark, sf_dir):
    """Fold of the action log: the last action of each user on each target stands."""
    last = F.max_by("emoji", F.struct("ts", "event_id")).alias("emoji")
    return d.reactions(spark, sf_dir).groupBy("user_id", "target_id").agg(last)


@query(
    "landing_counts",
    """SELECT (SELECT count(*) FROM release_events WHERE NOT archived AND status NOT IN ('RELEASED', 'CANCELLED')) AS live_events,
    (SELECT count(*) FROM installs WHERE enabled) AS enabled_installs, (SELECT count(*) FROM provider_runs WHERE status = 'FAILED') AS failed_runs""",
)
def landing(spark, sf_dir):
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    live = one(d.release_events(spark, sf_dir).where("NOT archived AND status NOT IN ('RELEASED', 'CANCELLED')"), "live_events")
    return live.crossJoin(one(d.installs(spark, sf_dir).where("enabled"), "enabled_installs")).crossJoin(one(d.provider_runs(spark, sf_dir).where("status = 'FAILED'"), "failed_runs"))


@query(
    "run_health",
    """SELECT scan_id, count(*) AS runs, count(*) FILTER (status = 'FAILED') AS failed, CASE WHEN count(*) FILTER (status = 'FAILED') = 0 THEN 'OK' WHEN count(*) FILTER (status = 'FAILED') = count(*) THEN 'FAILED' ELSE 'PARTIAL' END AS health
    FROM provider_runs GROUP BY scan_id""",
)
def run_health(spark, sf_dir):
    return health(d.provider_runs(spark, sf_dir))


@query(
    "provider_latest_run",
    "SELECT provider, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY started_at DESC, run_id DESC) AS r FROM provider_runs) WHERE r = 1",
)
def latest_run(spark, sf_dir):
    runs = d.provider_runs(spark, sf_dir)
    last = runs.groupBy("provider").agg(F.max_by(F.struct("run_id", "status"), F.struct("started_at", "run_id")).alias("x"))
    return last.select("provider", "x.run_id", "x.status")


@query(
    "provider_freshness",
    """SELECT provider, first_seen_at, last_ok_at, CAST(floor(epoch(TIMESTAMP '2024-02-01 00:00:00' - coalesce(last_ok_at, first_seen_at)) / 3600) AS BIGINT) AS hours,
    coalesce(last_ok_at, first_seen_at) <= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 48 HOUR AS stale
    FROM (SELECT provider, min(started_at) AS first_seen_at, max(started_at) FILTER (status = 'OK' AND value < 0.5) AS last_ok_at FROM provider_runs GROUP BY provider)""",
)
def provider_freshness(spark, sf_dir):
    runs = d.provider_runs(spark, sf_dir).withColumn("ok", F.expr("status = 'OK' AND value < 0.5"))
    return freshness(runs, "2024-02-01 00:00:00")


@query(
    "provider_three_way",
    """SELECT provider, runs, last_status, alarms FROM (SELECT provider, count(*) AS runs FROM provider_runs GROUP BY provider)
    LEFT JOIN (SELECT provider, status AS last_status FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY started_at DESC, run_id DESC) AS r FROM provider_runs) WHERE r = 1) USING (provider)
    LEFT JOIN (SELECT provider, count(*) AS alarms FROM provider_runs WHERE status = 'FAILED' AND value > 95 GROUP BY provider) USING (provider)""",
)
def three_way(spark, sf_dir):
    runs = d.provider_runs(spark, sf_dir)
    last = latest_run(spark, sf_dir).select("provider", F.col("status").alias("last_status"))
    alarms = runs.where("status = 'FAILED' AND value > 95").groupBy("provider").agg(F.count(F.lit(1)).alias("alarms"))
    return runs.groupBy("provider").agg(F.count(F.lit(1)).alias("runs")).join(last, "provider", "left").join(alarms, "provider", "left")


@query(
    "run_streaks",
    """SELECT provider, CAST(coalesce(min(rn) FILTER (status <> last) - 1, count(*)) AS BIGINT) AS streak FROM (SELECT *, row_number() OVER w AS rn, first_value(status) OVER w AS last FROM provider_runs
    WINDOW w AS (PARTITION BY provider ORDER BY started_at DESC, run_id DESC)) GROUP BY provider""",
)
def run_streaks(spark, sf_dir):
    rows = d.provider_runs(spark, sf_dir)
    return streaks(rows, ["provider"], [F.col("started_at").desc(), F.col("run_id").desc()], "status")


@query(
    "claim_streaks",
    """SELECT event_id, origin, CAST(coalesce(min(rn) FILTER (claim_date IS DISTINCT FROM last) - 1, count(*)) AS BIGINT) AS streak FROM (SELECT *, row_number() OVER w AS rn, first_value(claim_date) OVER w AS last
    FROM (SELECT event_id, origin, run, max(claim_date) AS claim_date FROM claims GROUP BY ALL) WINDOW w AS (PARTITION BY event_id, origin ORDER BY run DESC)) GROUP BY event_id, origin""",
)
def claim_streaks(spark, sf_dir):
    # one shuffle serves both steps; its partitions stay small, since Spark doesn't put those of a fixed number together
    rows = d.claims(spark, sf_dir).select("event_id", "origin", "run", "claim_date").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id", "origin")
    per_run = rows.groupBy("event_id", "origin", "run").agg(F.max("claim_date").alias("claim_date"))
    return streaks(per_run, ["event_id", "origin"], [F.col("run").desc()], "claim_date")


@query(
    "claim_history",
    """SELECT event_id, origin, count(DISTINCT claim_date) AS days, min(claim_date) AS first_seen, max(claim_date) AS last_seen, arg_max(tier, (run, ref)) AS tier FROM claims GROUP BY event_id, origin""", days=("first_seen", "last_seen"))
def claim_history(spark, sf_dir):
    return collapse_history(d.claims(spark, sf_dir))


@query(
    "claim_latest_silent",
    """SELECT event_id, origin, run, claim_date FROM (SELECT *, row_number() OVER (PARTITION BY event_id, origin ORDER BY run DESC, ref DESC, claim_date DESC) AS r FROM claims
    WHERE (event_id, origin) NOT IN (SELECT event_id, origin FROM claims WHERE live)) WHERE r = 1""", days=("claim_date",))
def latest_silent(spark, sf_dir):
    rows = d.claims(spark, sf_dir)
    silent = rows.join(rows.where("live").select("event_id", "origin"), ["event_id", "origin"], "left_anti")
    return top_by(silent, ["event_id", "origin"], [F.col(c).desc() for c in ("run", "ref", "claim_date")]).select("event_id", "origin", "run", "claim_date")


@query(
    "confidence",
    """SELECT event_id, CAST(floor(c * 1e6::DOUBLE + 0.25::DOUBLE) AS BIGINT) AS micro, CASE WHEN official OR c >= 0.6::DOUBLE THEN 'CONFIRMED' WHEN c >= 0.3::DOUBLE THEN 'ANNOUNCED' ELSE 'RUMORED' END AS status FROM (
      SELECT event_id, bool_or(tier = 'OFFICIAL') AS official, 1 - product(1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, weight * CASE tier WHEN 'OFFICIAL' THEN 1.0::DOUBLE WHEN 'RETAILER' THEN 0.7::DOUBLE WHEN 'COMMUNITY' THEN 0.45::DOUBLE ELSE 0.2::DOUBLE END))) AS c
      FROM claims GROUP BY event_id)""",
)
def confidence(spark, sf_dir):
    scored = d.placed_claims(spark, sf_dir).groupBy("event_id").agg(F.max(F.col("tier") == "OFFICIAL").alias("official"), noisy_or(F.col("tier"), F.col("weight"), F.col("place")).alias("c"))
    status = F.when(F.col("official") | (F.col("c") >= 0.6), "CONFIRMED").when(F.col("c") >= 0.3, "ANNOUNCED").otherwise("RUMORED")
    return scored.select("event_id", F.floor(F.col("c") * 1e6 + 0.25).cast("bigint").alias("micro"), status.alias("status"))


@query("widest_gap", "SELECT event_id, CASE WHEN count(claim_date) >= 2 THEN CAST(max(claim_date) - min(claim_date) AS INTEGER) END AS gap FROM claims WHERE live GROUP BY event_id")
def widest_gap(spark, sf_dir):
    return d.claims(spark, sf_dir).where("live").groupBy("event_id").agg(F.when(F.count("claim_date") >= 2, F.datediff(F.max("claim_date"), F.min("claim_date"))).alias("gap"))


@query(
    "agreeing_pairs",
    """SELECT a.event_id, count(*) AS pairs FROM claims a JOIN claims b ON a.event_id = b.event_id AND a.origin < b.origin AND abs(a.claim_date - b.claim_date) <= 3 GROUP BY a.event_id""",
)
def agreeing_pairs(spark, sf_dir):
    rows = d.claims(spark, sf_dir).select("event_id", "origin", "claim_date")
    a, b = rows.alias("a"), rows.alias("b")
    near = gap_days(F.col("a.claim_date"), F.col("b.claim_date")) <= 3
    return a.join(b, (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.origin") < F.col("b.origin")) & near).groupBy(F.col("a.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("pairs"))


@query(
    "contradicted_claims",
    """SELECT event_id, origin, run FROM claims a WHERE live AND EXISTS (SELECT 1 FROM claims b WHERE b.live AND b.event_id = a.event_id AND b.origin <> a.origin AND abs(b.claim_date - a.claim_date) > 3)""",
)
def contradicted(spark, sf_dir):
    rows = d.claims(spark, sf_dir).where("live").select("event_id", "origin", "run", "claim_date")
    a, b = rows.alias("a"), rows.alias("b")
    apart = (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.origin") != F.col("b.origin")) & (gap_days(F.col("a.claim_date"), F.col("b.claim_date")) > 3)
    return a.join(b, apart, "left_semi").select("event_id", "origin", "run")


@query("ambiguous_codes", "SELECT install_id, code, count(DISTINCT name) AS names FROM product_sets GROUP BY install_id, code HAVING count(DISTINCT name) > 1")
def ambiguous(spark, sf_dir):
    return d.product_sets(spark, sf_dir).groupBy("install_id", "code").agg(F.countDistinct("name").alias("names")).where("names > 1")


@query("install_counts", "SELECT slug, count(user_id) AS subscribers FROM installs LEFT JOIN subscriptions USING (install_id) GROUP BY slug")
def install_counts(spark, sf_dir):
    return d.installs(spark, sf_dir).join(d.subscriptions(spark, sf_dir), "install_id", "left").groupBy("slug").agg(F.count("user_id").alias("subscribers"))


@query("candidates_per_origin", "SELECT origin, count(*) AS n, count(DISTINCT event_id) AS events, max(claim_date) AS latest FROM claims GROUP BY origin", days=("latest",))
def per_origin(spark, sf_dir):
    return d.claims(spark, sf_dir).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"), F.max("claim_date").alias("latest"))


@query("grouped_to_list", "SELECT event_id, string_agg(origin, ',' ORDER BY run, origin, ref) AS origins FROM claims WHERE live GROUP BY event_id")
def to_list(spark, sf_dir):
    entries = F.array_sort(F.collect_list(F.struct("run", "origin", "ref")))
    return d.claims(spark, sf_dir).where("live").groupBy("event_id").agg(F.array_join(F.transform(entries, lambda x: x["origin"]), ",").alias("origins"))


@query(
    "rate_window",
    """SELECT event_id, (SELECT count(*) FROM reactions b WHERE b.user_id = a.user_id AND b.ts >= a.ts - INTERVAL 6 HOUR AND b.ts < a.ts) AS before FROM reactions a""",
)
def rate_window(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.expr("unix_micros(cast(ts as timestamp))")).rangeBetween(-6 * 3600 * 1_000_000, -1)
    return d.reactions(spark, sf_dir).select("event_id", F.count(F.lit(1)).over(w).alias("before"))


@query(
    "news_latest",
    "SELECT source, doc_id, published_on FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY published_on DESC, doc_id DESC) AS r FROM news) WHERE r = 1", days=("published_on",))
def news_latest(spark, sf_dir):
    last = d.news(spark, sf_dir).groupBy("url_key").agg(F.max_by(F.struct("source", "doc_id", "published_on"), F.struct("published_on", "doc_id")).alias("x"))
    return last.select("x.source", "x.doc_id", "x.published_on")


@query("news_feed", "SELECT doc_id, source, published_on FROM news WHERE published_on > DATE '2024-07-10' - 90 AND source IN ('src1', 'src2') ORDER BY published_on DESC, doc_id LIMIT 150", days=("published_on",))
def news_feed(spark, sf_dir):
    kept = d.news(spark, sf_dir).where((F.col("published_on") > F.date_sub(F.lit("2024-07-10").cast("date"), 90)) & F.col("source").isin("src1", "src2"))
    return kept.orderBy(F.col("published_on").desc(), "doc_id").limit(150).select("doc_id", "source", "published_on")


@query("news_archived", "SELECT doc_id, published_on <= DATE '2024-07-10' - 90 AS archived FROM news")
def news_archived(spark, sf_dir):
    return d.news(spark, sf_dir).select("doc_id", (F.col("published_on") <= F.date_sub(F.lit("2024-07-10").cast("date"), 90)).alias("archived"))


@query("unchanged_payloads", "SELECT source, count(*) AS bodies, count(DISTINCT url_key) AS distinct_bodies FROM news GROUP BY source")
def unchanged(spark, sf_dir):
    return d.news(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("bodies"), F.countDistinct("url_key").alias("distinct_bodies"))


@query("json_property", "SELECT run_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props IS NOT NULL AS has_props FROM provider_runs")
def json_property(spark, sf_dir):
    return d.provider_runs(spark, sf_dir).select("run_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("props").isNotNull().alias("has_props"))


# Extras beyond the reproduced system: built-in time windows and grouping sets.
@query("extra_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, started_at) AS start, status, count(*) AS n FROM provider_runs GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    return d.provider_runs(spark, sf_dir).groupBy(F.window("started_at", "6 hours").alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")


@query("extra_rollup", "SELECT type, region, count(*) AS n FROM release_events GROUP BY ROLLUP (type, region)")
def rollup(spark, sf_dir):
    return d.release_events(spark, sf_dir).rollup("type", "region").agg(F.count(F.lit(1)).alias("n"))


@query("extra_cube", "SELECT kind, status, count(*) AS n FROM release_events GROUP BY CUBE (kind, status)")
def cube(spark, sf_dir):
    return d.release_events(spark, sf_dir).cube("kind", "status").agg(F.count(F.lit(1)).alias("n"))
