"""What a request asks for and what it is shown: parameters and defaults, labels, own reactions, ordered lists; and identity, tier by tier."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_name, is_placeholder
from tidemark.operators import identity, requests
from tidemark.plans.base import query
from tidemark.plans.decisions import identity_inputs
from tidemark.schema import EVENT_TYPES, REGION_LABELS, STATUSES, STOP_WORDS, TYPE_LABELS
from tidemark.sources import domain as d


@query("request_parameters", "SELECT set_id, CASE set_id % 5 WHEN 0 THEN 'calendar' WHEN 1 THEN 'list' WHEN 2 THEN 'calendar' WHEN 3 THEN 'upcoming' ELSE 'unconfirmed' END AS tab, CASE WHEN set_id % 3 = 0 THEN '2024-0' || set_id % 9 + 1 ELSE '2024-02' END AS month, CASE set_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'SHELF,PROMO' WHEN 2 THEN 'PROMO' ELSE 'SPECIAL,SPECIAL' END AS types, CASE WHEN set_id % 2 = 0 THEN 'RUMORED' ELSE '' END AS statuses, CASE WHEN set_id % 2 = 0 THEN set_id || ',7' ELSE '' END AS installs, CASE WHEN set_id % 3 = 1 THEN 'dark tide' ELSE '' END AS search FROM product_sets")
def request_parameters(spark, sf_dir):
    """Unknown tabs and bad months fall back, unknown values of lists go, blanks around values too."""
    s = d.product_sets(spark, sf_dir)
    when = lambda c, v: F.when(F.expr(c), v)
    raw = s.select(
        "set_id", d.pick(F.col("set_id") % 5, "calendar", "list", "bogus", "upcoming", "unconfirmed").alias("tab"), when("set_id % 3 = 0", F.concat(F.lit("2024-0"), (F.col("set_id") % 9 + 1).cast("string"))).when(F.expr("set_id % 3 = 1"), F.lit("2024-1")).alias("month"),
        when("set_id % 4 = 1", F.lit("SHELF, bogus,PROMO")).when(F.expr("set_id % 4 = 2"), F.lit(" PROMO")).when(F.expr("set_id % 4 = 3"), F.lit("SPECIAL,SPECIAL,shelf")).alias("types"), when("set_id % 2 = 0", F.lit("RUMORED,x")).alias("statuses"),
        when("set_id % 2 = 0", F.concat(F.lit(" "), "set_id", F.lit(" ,, 7"))).alias("installs"), when("set_id % 3 = 1", F.lit("  dark tide ")).alias("search"),
    )
    joined = {c: F.array_join(c, ",") for c in ("types", "statuses", "installs")}
    return requests.parsed(raw, "2024-02").withColumns(joined)


@query("request_defaults", "SELECT user_id, 'SHELF,PRERELEASE,SPECIAL' AS types, CAST(install_id AS VARCHAR) AS installs FROM subscriptions WHERE user_id % 2 = 0 UNION ALL SELECT user_id, 'PROMO', '' FROM subscriptions WHERE user_id % 2 = 1")
def request_defaults(spark, sf_dir):
    """A bare request shows all types but promos and the subscribed installs; one with any filter is taken as it is."""
    users = d.subscriptions(spark, sf_dir)
    own = users.groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("install_id").cast("string"))).alias("subscribed"))
    raw = users.select("user_id", *[F.lit(None).cast("string").alias(c) for c in ("tab", "month", "statuses", "installs", "search")], F.when(F.expr("user_id % 2 = 1"), F.lit("PROMO")).alias("types"))
    rows = requests.with_defaults(requests.parsed(raw, "2024-02").join(own, "user_id"), "subscribed")
    return rows.select("user_id", F.array_join("types", ",").alias("types"), F.array_join("installs", ",").alias("installs"))


@query("badge_labels", "SELECT event_id, CASE region WHEN 'GLOBAL' THEN NULL WHEN 'OTHER' THEN 'Regional' ELSE region END AS region, CASE type WHEN 'SHELF' THEN NULL WHEN 'PRERELEASE' THEN 'Prerelease' ELSE 'Promo' END AS type FROM release_events")
def badge_labels(spark, sf_dir):
    """No label for the common case."""
    return d.release_events(spark, sf_dir).select("event_id", requests.label(F.col("region"), REGION_LABELS).alias("region"), requests.label(F.col("type"), TYPE_LABELS).alias("type"))


@query("origin_labels", "SELECT DISTINCT origin, upper(origin[1]) || origin[2:] || ' Official' AS label FROM claims")
def origin_labels(spark, sf_dir):
    rows = d.claims(spark, sf_dir).select("origin").distinct()
    return rows.select("origin", requests.origin_label(F.concat("origin", F.lit("-official")), F.lit(None), F.lit("")).alias("label"))


@query("admin_addresses", "SELECT user_id, user_id % 10 = 3 OR user_id % 10 = 4 AS is_admin FROM subscriptions")
def admin_addresses(spark, sf_dir):
    address = F.concat(F.lit("User"), F.col("user_id") % 10, F.lit("@Example.org"))
    return d.subscriptions(spark, sf_dir).select("user_id", requests.is_listed(address, F.lit(" user3@example.org,USER4@EXAMPLE.ORG ,")).alias("is_admin"))


@query("own_reactions", "SELECT a.target_id, a.n, b.emoji AS own FROM (SELECT target_id, count(*) AS n FROM reactions GROUP BY target_id) a LEFT JOIN (SELECT target_id, arg_max(emoji, (ts, event_id)) AS emoji FROM reactions WHERE user_id = 7 GROUP BY target_id) b USING (target_id)")
def own_reactions(spark, sf_dir):
    """Counts of all and the viewer's own last reaction."""
    rows = d.reactions(spark, sf_dir)
    own = rows.where("user_id = 7").groupBy("target_id").agg(F.max_by("emoji", F.struct("ts", "event_id")).alias("own"))
    return rows.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).join(own, "target_id", "left")


@query("ordered_lists", "SELECT user_id, row_number() OVER (PARTITION BY install_id ORDER BY slug, user_id DESC) AS place FROM subscriptions JOIN installs USING (install_id) WHERE premium")
def ordered_lists(spark, sf_dir):
    """Users of each install in order of its package's name, latest first."""
    rows = d.subscriptions(spark, sf_dir).where("premium").join(d.installs(spark, sf_dir), "install_id")
    return rows.select("user_id", F.row_number().over(Window.partitionBy("install_id").orderBy("slug", F.col("user_id").desc())).cast("bigint").alias("place"))


@query("keys_in_order", "SELECT run_id, provider FROM (SELECT provider, run_id, row_number() OVER (PARTITION BY provider ORDER BY started_at DESC, run_id DESC) AS r FROM provider_runs) WHERE r <= 2 ORDER BY provider COLLATE C, run_id LIMIT 15".replace(" COLLATE C", ""))
def keys_in_order(spark, sf_dir):
    """The last two runs of each provider, in order of its key."""
    w = Window.partitionBy("provider").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return d.provider_runs(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 2").orderBy("provider", "run_id").limit(15).select("run_id", "provider")


@query("scan_runs_page", "SELECT scan_id, runs FROM (SELECT scan_id, count(*) AS runs, max(started_at) AS last FROM provider_runs GROUP BY scan_id) ORDER BY last DESC, scan_id LIMIT 10")
def scan_runs_page(spark, sf_dir):
    """The ten runs that were last active."""
    runs = d.provider_runs(spark, sf_dir).groupBy("scan_id").agg(F.count(F.lit(1)).alias("runs"), F.max("started_at").alias("last"))
    return runs.orderBy(F.col("last").desc(), "scan_id").limit(10).select("scan_id", "runs")


@query("day_statuses", "SELECT day, string_agg(status, ',' ORDER BY first) FILTER (n <= 3) AS statuses, count(*) > 3 AS more FROM (SELECT day, status, first, row_number() OVER (PARTITION BY day ORDER BY first) AS n FROM (SELECT date_exact AS day, status, min(event_id) AS first FROM release_events WHERE kind = 'EXACT' GROUP BY ALL)) GROUP BY day", days=("day",))
def day_statuses(spark, sf_dir):
    """The first three statuses of each day, in order of its events, and whether there are more."""
    rows = d.release_events(spark, sf_dir).where("kind = 'EXACT'").select(F.col("date_exact").alias("day"), "status", "event_id")
    return requests.first_statuses(rows, 3)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_INPUTS = f"""WITH s AS (SELECT set_id, install_id AS game, name, regexp_replace(upper(code), '[^A-Z0-9]+', '', 'g') AS code, size FROM product_sets),
  c AS (SELECT set_id, game, name, CASE WHEN size % 3 = 0 THEN code END AS code FROM s WHERE set_id % 2 = 1), k AS (SELECT * FROM s WHERE set_id % 2 = 0),
  w AS (SELECT name, list_sort(list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({_STOP})))) AS t FROM (SELECT DISTINCT name FROM s))"""


@query("identity_by_id", "SELECT CAST(set_id AS VARCHAR) AS candidate_id, CAST(2 * (set_id % 50) AS VARCHAR) AS set_id FROM product_sets WHERE set_id % 2 = 1 AND set_id % 50 < 10")
def identity_by_id(spark, sf_dir):
    candidates, _, identities = identity_inputs(spark, sf_dir)
    return identity.by_id(candidates, identities).select("candidate_id", "set_id")


@query("identity_by_code", f"{_INPUTS} SELECT CAST(c.set_id AS VARCHAR) AS candidate_id, CAST(min(k.set_id) AS VARCHAR) AS set_id FROM c JOIN k USING (game, code) WHERE (game, code) NOT IN (SELECT (game, code) FROM c WHERE code IS NOT NULL GROUP BY game, code HAVING count(DISTINCT name) > 1) GROUP BY c.set_id HAVING count(*) = 1")
def identity_by_code(spark, sf_dir):
    candidates, sets, _ = identity_inputs(spark, sf_dir)
    return identity.by_code(candidates, sets)


@query("identity_by_name", f"{_INPUTS}, p AS (SELECT a.name AS x, b.name AS y, CASE WHEN a.t = b.t THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)) END AS score FROM w a, w b), m AS (SELECT c.set_id AS candidate_id, k.set_id, score, row_number() OVER (PARTITION BY c.set_id ORDER BY score DESC, k.set_id) AS n FROM c JOIN p ON p.x = c.name AND p.score >= 0.75 JOIN k ON k.name = p.y AND k.game = c.game WHERE c.code IS NULL OR c.code = k.code) SELECT CAST(candidate_id AS VARCHAR) AS candidate_id, CAST(set_id AS VARCHAR) AS set_id, CAST(floor(score * 1e6::DOUBLE + 0.25::DOUBLE) AS BIGINT) AS micro FROM m WHERE n = 1")
def identity_by_name(spark, sf_dir):
    candidates, sets, _ = identity_inputs(spark, sf_dir)
    return identity.by_name(candidates, sets).select("candidate_id", "set_id", F.floor(F.col("score") * 1e6 + 0.25).cast("bigint").alias("micro"))


@query("placeholder_names", "SELECT set_id, set_id % 4 IN (0, 1) AS placeholder FROM product_sets")
def placeholder_names(spark, sf_dir):
    """Names that stand for an unknown product; a real title that only begins alike is none."""
    name = d.pick(F.col("set_id") % 4, "TBA", "Unnamed Set", "Untamed Seas", "Unknown")
    said = F.when(F.expr("set_id % 4 = 3"), F.lit("Unknowns of the deep seas")).otherwise(name)
    return d.product_sets(spark, sf_dir).select("set_id", is_placeholder(clean_name(said)).alias("placeholder"))


@query("digest_recipients", "SELECT user_id FROM subscriptions JOIN (SELECT c_custkey AS user_id, c_acctbal < 500 AS removed, c_custkey % 7 = 0 AS banned FROM customer) USING (user_id) WHERE premium AND alerts AND NOT removed AND NOT banned")
def digest_recipients(spark, sf_dir):
    accounts = d.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 500).alias("removed"), (F.col("c_custkey") % 7 == 0).alias("banned"))
    return requests.recipients(d.subscriptions(spark, sf_dir), accounts).select("user_id")


@query("known_values", f"SELECT DISTINCT status, list_position({STATUSES}, status) - 1 AS place, type IN {tuple(EVENT_TYPES)} AS known FROM release_events")
def known_values(spark, sf_dir):
    """Enumerations are closed; a status has its place in their order."""
    rows = d.release_events(spark, sf_dir).select("status", "type").distinct()
    place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")) - 1
    return rows.select("status", place.cast("int").alias("place"), F.col("type").isin(*EVENT_TYPES).alias("known")).distinct()
