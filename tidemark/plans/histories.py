"""Histories in order: rate limits, changes of payloads through a stream, notices, crawls, slugs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import slug
from tidemark.operators import claims as c
from tidemark.operators import limits
from tidemark.operators.snapshots import scratch, settled
from tidemark.plans.base import query
from tidemark.sources import domain as d
from tidemark.sources import payloads
from tidemark.streaming import jobs

UNTIL = "2024-02-05 00:00:00"


@query(
    "rate_limited",
    """WITH RECURSIVE h AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM reactions),
    f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed, CAST([] AS BIGINT[]) AS kept FROM h
      UNION ALL SELECT user_id, k, event_id, len(recent) < 2, CASE WHEN len(recent) < 2 THEN list_append(recent, us) ELSE recent END FROM (SELECT h.*, list_filter(f.kept, lambda t: h.us - t < 86400000000) AS recent FROM f JOIN h ON h.user_id = f.user_id AND h.k = f.k + 1))
    SELECT user_id, event_id, allowed FROM f WHERE k > 0""",
)
def rate_limited(spark, sf_dir):
    """Two reactions a day are let through; what was turned away doesn't count."""
    return limits.rate_limited(d.reactions(spark, sf_dir), "user_id", "ts", "event_id", 2, 24 * 3600)


@query("payload_changes", "SELECT provider, fetched_at, seq, sha256 FROM (SELECT CAST(user_id % 11 AS VARCHAR) AS provider, ts AS fetched_at, event_id AS seq, sha256(event_type) AS sha256, lag(event_type) OVER (PARTITION BY user_id % 11 ORDER BY ts, event_id) AS before, event_type FROM events) WHERE before IS DISTINCT FROM event_type")
def payload_changes(spark, sf_dir):
    """A stream over the files of `events`, taken to its end: what each provider sent that differs from what it sent before."""
    source = d.read(spark, sf_dir, "events")
    files = spark.readStream.schema(source.schema)  # the stream reads folders: the table's own, or where it is a file the one around it
    alone = all(f.endswith("/events.parquet") for f in source.inputFiles())
    stream = (files.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if alone else files.parquet(f"{sf_dir}/events.parquet")).select((F.col("user_id") % 11).cast("string").alias("provider"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq"), F.sha2("event_type", 256).alias("sha256"))
    place = scratch(spark)
    return jobs.ingest_changes(spark, stream, f"{place}/out", f"{place}/progress")


@query(
    "alarm_history",
    f"""WITH r AS (SELECT user_id AS provider, ts, event_type IN ('view', 'click') AS ok FROM events), g AS (SELECT provider, min(ts) AS ts FROM r GROUP BY provider UNION SELECT provider, ts FROM r WHERE ok),
    n AS (SELECT provider, ts + INTERVAL 48 HOUR AS opened_at, lead(ts) OVER (PARTITION BY provider ORDER BY ts) AS next FROM g),
    s AS (SELECT *, coalesce(next, TIMESTAMP '{UNTIL}') AS until FROM n),
    e AS (SELECT provider, opened_at, unnest(generate_series(opened_at, until, INTERVAL 24 HOUR)) AS told FROM s WHERE opened_at <= until)
    SELECT provider, told AS "at", CASE WHEN told = opened_at THEN 'stale' ELSE 'still stale' END AS notice, opened_at FROM e
    UNION ALL SELECT provider, next, 'recovered', opened_at FROM s WHERE opened_at <= next""",
)
def alarm_history(spark, sf_dir):
    """Every notice of every provider: opened two days after the last good run, repeated daily, closed by the next."""
    runs = d.read(spark, sf_dir, "events").select(F.col("user_id").alias("provider"), F.col("ts").alias("at"), F.col("event_type").isin("view", "click").alias("ok"))
    return limits.alarm_history(runs, UNTIL)


@query(
    "bounded_crawl",
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
    l AS (SELECT page_id AS page, position, CAST('0x' || left(sha256(href), 7) AS BIGINT) % (n + n // 10) AS target FROM (SELECT page_id, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS position FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages)), n),
    c AS (SELECT CAST(page_id % 9 AS BIGINT) AS site, CAST(0 AS INTEGER) AS depth, [{'page': min(page_id), 'depth': 0, 'parent': CAST(NULL AS BIGINT), 'place': CAST(1 AS BIGINT), 'fetched': true}] AS seen FROM pages GROUP BY page_id % 9
      UNION ALL
      SELECT site, depth + 1, list_concat(any_value(seen), list({'page': target, 'depth': depth + 1, 'parent': parent, 'place': place, 'fetched': fetched} ORDER BY place)) AS seen FROM (
        SELECT site, depth, seen, target, found.parent AS parent, len(seen) + row_number() OVER (PARTITION BY site ORDER BY found.place, found.position, target) AS place, target IN (SELECT page_id FROM pages) AS fetched FROM (
          SELECT site, depth, any_value(seen) AS seen, target, min({'place': v.place, 'position': position, 'parent': v.page}) AS found
          FROM (SELECT site, depth, seen, unnest(list_filter(seen, lambda x: x.depth = depth AND x.fetched)) AS v FROM c) JOIN l ON l.page = v.page WHERE NOT list_contains(list_transform(seen, lambda x: x.page), target) GROUP BY site, depth, target))
      WHERE depth < 3 AND place <= 12 GROUP BY site, depth)
    SELECT site, v.page AS page, v.depth AS depth, v.parent AS parent, v.place AS place, v.fetched AS fetched FROM (SELECT site, unnest(arg_max(seen, len(seen))) AS v FROM c GROUP BY site)""",
)
def bounded_crawl(spark, sf_dir):
    """Nine sites, twelve pages each at most, three links away at most; a link leads to the page that its hash names, some to none."""
    pages = d.read(spark, sf_dir, "pages")
    n = pages.count()
    target = F.conv(F.substring(F.sha2("href", 256), 1, 7), 16, 10).cast("long") % (n + n // 10)
    links = pages.select(F.col("page_id").alias("page"), F.posexplode(payloads.links(F.col("html"))).alias("position", "href")).select("page", "position", target.alias("target"))
    seeds = pages.groupBy((F.col("page_id") % 9).alias("site")).agg(F.min("page_id").alias("page")).withColumn("position", F.lit(0))
    return limits.crawl(links, seeds, pages.select(F.col("page_id").alias("page")), 12, 3)


@query(
    "slugs_in_order",
    """WITH RECURSIVE b AS (SELECT install_id, set_id, CASE WHEN set_id % 6 = 5 THEN split_part(name, ' ', 1) WHEN set_id % 6 = 4 THEN '' ELSE replace(name, ' ', '-') END AS base, CASE WHEN set_id % 6 = 5 THEN split_part(name, ' ', 2) ELSE 'k' || size % 7 END AS code FROM product_sets),
    s AS (SELECT *, list_filter([nullif(base, ''), CASE WHEN base = '' THEN code ELSE base || '-' || code END, coalesce(nullif(base, ''), 'set') || '-' || left(sha256(install_id || '|' || set_id), 6), coalesce(nullif(base, ''), 'set') || '-' || left(sha256(install_id || '|' || set_id), 6) || '-' || set_id], lambda c: c IS NOT NULL) AS choices, row_number() OVER (PARTITION BY install_id ORDER BY set_id) AS k FROM b WHERE set_id >= 20),
    f AS (SELECT install_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS set_id, CAST(NULL AS VARCHAR) AS slug, list(DISTINCT coalesce(nullif(base, ''), 'set')) AS taken FROM b WHERE set_id < 20 GROUP BY install_id
      UNION ALL SELECT install_id, k, set_id, slug, list_append(taken, slug) FROM (SELECT s.install_id, s.k, s.set_id, f.taken, list_filter(s.choices, lambda c: NOT list_contains(f.taken, c))[1] AS slug FROM f JOIN s ON s.install_id = f.install_id AND s.k = f.k + 1))
    SELECT install_id, set_id, slug FROM f WHERE k > 0""",
)
def slugs_in_order(spark, sf_dir):
    """Sets get the first free slug of theirs, in order; some bases are what another set's base and code make together, and those of the first sets are stored."""
    sets, six = d.product_sets(spark, sf_dir), F.col("set_id") % 6
    base = F.when(six == 5, F.split("name", " ")[0]).when(six == 4, "").otherwise(slug(F.col("name")))
    code = F.when(six == 5, F.split("name", " ")[1]).otherwise(F.concat(F.lit("k"), (F.col("size") % 7).cast("string")))
    rows = sets.select("install_id", "set_id", base.alias("base"), code.alias("code"))
    stored = rows.where("set_id < 20").select("install_id", F.coalesce(F.nullif("base", F.lit("")), F.lit("set")).alias("slug"))
    return limits.unique_slugs(rows.where("set_id >= 20"), stored)


@query(
    "claim_state",
    """SELECT event_id, origin, max(last) AS claim_date, CAST(coalesce(min(rn) FILTER (claim_date IS DISTINCT FROM last) - 1, count(*)) AS BIGINT) AS streak, CAST((SELECT max(run) FROM claims) - max(run) AS BIGINT) AS missed
    FROM (SELECT *, row_number() OVER w AS rn, first_value(claim_date) OVER w AS last FROM (SELECT event_id, origin, run, max(claim_date) AS claim_date FROM claims GROUP BY ALL) WINDOW w AS (PARTITION BY event_id, origin ORDER BY run DESC)) GROUP BY event_id, origin""",
    days=("claim_date",),
)
def claim_state(spark, sf_dir):
    """Streaks and silence carried from run to run: each run reads the state before and its own claims, no history."""
    rows = d.claims(spark, sf_dir).select("event_id", "origin", "run", "claim_date")
    runs = sorted(r.run for r in rows.select("run").distinct().collect())
    state = c.first_state(rows)
    for run in runs:
        state = settled(c.advanced(state, rows.where(F.col("run") == run)))
    return state
