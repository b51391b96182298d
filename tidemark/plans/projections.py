"""Nested rows, flattening, messages, links and account predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.delivery import add_to_calendar, digest_text
from tidemark.plans.base import query
from tidemark.sources import domain as d


@query("review_queue", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY origin, run, ref, claim_date) - 1 AS INTEGER) AS place, origin, claim_date FROM claims WHERE live AND tier <> 'SPECULATIVE'", days=("claim_date",))
def review_queue(spark, sf_dir):
    """Each claim that may decide, of all events, with its index."""
    rows = d.claims(spark, sf_dir).where("live AND tier <> 'SPECULATIVE'").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("origin", "run", "ref", "claim_date"))).alias("claims"))
    return rows.select("event_id", F.posexplode("claims").alias("place", "c")).select("event_id", "place", "c.origin", "c.claim_date")


@query("live_claim_places", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY origin, run, ref, claim_date) - 1 AS INTEGER) AS place, origin, claim_date FROM claims WHERE live", days=("claim_date",))
def live_claim_places(spark, sf_dir):
    """Each live claim of all events with its index."""
    rows = d.claims(spark, sf_dir).where("live").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("origin", "run", "ref", "claim_date"))).alias("claims"))
    return rows.select("event_id", F.posexplode("claims").alias("place", "c")).select("event_id", "place", "c.origin", "c.claim_date")


@query("nested_set", "SELECT set_id, name, slug, count(*) AS events, min(event_id) AS first_event FROM release_events JOIN product_sets USING (set_id) JOIN installs USING (install_id) GROUP BY set_id, name, slug")
def nested_set(spark, sf_dir):
    """Sets with their events and install nested, then read through the nesting."""
    events = d.release_events(spark, sf_dir).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "type", "status"))).alias("events"))
    nested = d.product_sets(spark, sf_dir).join(events, "set_id").join(d.installs(spark, sf_dir).select("install_id", F.struct("slug", "game").alias("install")), "install_id")
    return nested.select("set_id", "name", F.col("install.slug").alias("slug"), F.size("events").cast("bigint").alias("events"), F.col("events")[0]["event_id"].alias("first_event"))


@query("change_context", "SELECT event_id, coalesce(CASE WHEN set_id % 3 <> 0 THEN name END, CASE WHEN set_id % 2 = 0 THEN code END, 'Unknown product') AS title, game FROM release_events JOIN product_sets USING (set_id) JOIN installs USING (install_id) WHERE status = 'RELEASED'")
def change_context(spark, sf_dir):
    rows = d.release_events(spark, sf_dir).where("status = 'RELEASED'").join(d.product_sets(spark, sf_dir), "set_id").join(d.installs(spark, sf_dir), "install_id")
    return rows.select("event_id", F.coalesce(F.expr("CASE WHEN set_id % 3 <> 0 THEN name END"), F.expr("CASE WHEN set_id % 2 = 0 THEN code END"), F.lit("Unknown product")).alias("title"), "game")


@query("date_json", """SELECT event_id, CASE kind WHEN 'EXACT' THEN '{"kind":"EXACT","date":"' || date_exact || '"}' WHEN 'RANGE' THEN '{"kind":"RANGE","start":"' || date_start || '","end":"' || date_end || '"}' WHEN 'WINDOW' THEN '{"kind":"WINDOW","start":"' || window_start || '","end":"' || window_end || '","granularity":"MONTH"}' ELSE '{"kind":"TBD"}' END AS json FROM release_events""")
def date_json(spark, sf_dir):
    """to_json leaves nulls out, so one struct serves every kind of date."""
    text = lambda *c: F.coalesce(*c).cast("string")
    body = F.struct("kind", text("date_exact").alias("date"), text("date_start", "window_start").alias("start"), text("date_end", "window_end").alias("end"), "granularity")
    return d.release_events(spark, sf_dir).select("event_id", F.to_json(body).alias("json"))


@query("digest_messages", "SELECT set_id, count(*) || ' release' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' coming up' AS subject, substr(string_agg(type || ' in ' || region, chr(10) ORDER BY date_exact, type || ' in ' || region), 1, 2000) AS body FROM release_events WHERE kind = 'EXACT' GROUP BY set_id")
def digest_messages(spark, sf_dir):
    rows = d.release_events(spark, sf_dir).where("kind = 'EXACT'").select("set_id", F.col("date_exact").alias("day"), F.concat("type", F.lit(" in "), "region").alias("line"))
    return digest_text(rows, "set_id")


@query("calendar_links", "SELECT event_id, 'https://calendar.google.com/calendar/render?action=TEMPLATE&text=' || replace(name, ' ', '+') || '&dates=' || strftime(date_start, '%Y%m%d') || '/' || strftime(date_end + 1, '%Y%m%d') AS google, 'https://outlook.live.com/calendar/0/deeplink/compose?subject=' || replace(name, ' ', '+') || '&allday=true&startdt=' || date_start || '&enddt=' || date_end AS outlook FROM release_events JOIN product_sets USING (set_id) WHERE kind = 'RANGE'")
def calendar_links(spark, sf_dir):
    rows = d.release_events(spark, sf_dir).where("kind = 'RANGE'").join(d.product_sets(spark, sf_dir), "set_id")
    google, outlook = add_to_calendar(F.col("name"), F.col("date_start"), F.col("date_end"))
    return rows.select("event_id", google.alias("google"), outlook.alias("outlook"))


@query("accounts_due", "SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'HOUSEHOLD'")
def accounts_due(spark, sf_dir):
    """Removal is due and no ban holds it; a ban beats a removal."""
    accounts = d.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("due"), (F.col("c_mktsegment") == "HOUSEHOLD").alias("banned"))
    return accounts.where("due AND NOT banned").select("user_id")


@query("visible_comments", "SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND conv_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def visible_comments(spark, sf_dir):
    """Comments whose author is neither removed nor banned."""
    gone = d.read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("conv_id"))
    return d.read(spark, sf_dir, "conversations").where("role <> 'system'").join(gone, "conv_id", "left_anti").select("conv_id", "turn")


@query("shared_installs", "SELECT a.install_id AS a, b.install_id AS b, count(DISTINCT a.name) AS shared FROM product_sets a JOIN product_sets b ON a.name = b.name AND a.install_id < b.install_id GROUP BY 1, 2")
def shared_installs(spark, sf_dir):
    names = d.product_sets(spark, sf_dir).select("install_id", "name").distinct()
    a, b = names.alias("a"), names.alias("b")
    return a.join(b, F.expr("a.name = b.name AND a.install_id < b.install_id")).groupBy(F.col("a.install_id").alias("a"), F.col("b.install_id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


@query("latest_payload", "SELECT page_id, length(html) AS chars FROM pages WHERE length(html) > 0 ORDER BY page_id DESC LIMIT 1")
def latest_payload(spark, sf_dir):
    """The id is found first; only then is one body read."""
    pages = d.read(spark, sf_dir, "pages")
    last = pages.where(F.length("html") > 0).orderBy(F.col("page_id").desc()).limit(1)
    return last.select("page_id", F.length("html").cast("bigint").alias("chars"))


@query("failed_providers", "SELECT DISTINCT scan_id, provider FROM provider_runs r WHERE status = 'FAILED' AND NOT EXISTS (SELECT 1 FROM provider_runs o WHERE o.scan_id = r.scan_id AND o.provider = r.provider AND o.status = 'OK')")
def failed_providers(spark, sf_dir):
    """What a retry of a run fetches again."""
    runs = d.provider_runs(spark, sf_dir).select("scan_id", "provider", "status")
    ok = runs.where("status = 'OK'").select("scan_id", "provider")
    return runs.where("status = 'FAILED'").select("scan_id", "provider").distinct().join(ok, ["scan_id", "provider"], "left_anti")


@query("health_probe", "SELECT CAST(count(*) > 0 AS INTEGER) AS ok FROM installs WHERE enabled")
def health_probe(spark, sf_dir):
    """Whether the store answers: one row that says so."""
    return d.installs(spark, sf_dir).where("enabled").agg((F.count(F.lit(1)) > 0).cast("int").alias("ok"))


@query("card_order", "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'news,health' ELSE 'calendar,news,trending' END AS cards FROM subscriptions")
def card_order(spark, sf_dir):
    """Known ids of a stored order, once each; without a stored order the default."""
    stored = F.when(F.col("user_id") % 3 == 0, F.array(*[F.lit(x) for x in ("news", "bogus", "health", "news")]))
    known = F.array(*[F.lit(x) for x in ("calendar", "news", "trending", "health")])
    cards = F.coalesce(F.array_distinct(F.filter(stored, lambda c: F.array_contains(known, c))), F.slice(known, 1, 3))
    return d.subscriptions(spark, sf_dir).select("user_id", F.array_join(cards, ",").alias("cards"))
