"""The gate, its diff, schedules, lifecycle and identity over the domain's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import derive, gate, identity, replay
from tidemark.operators.claims import independent
from tidemark.operators.snapshots import settled
from tidemark.plans.base import query
from tidemark.schema import GAMES, ORIGINS, STOP_WORDS
from tidemark.sources import domain as d

NOW = "1998-06-01"


def gate_inputs(spark, sf_dir, schedule: bool = False):
    claims = d.placed_claims(spark, sf_dir).select(
        "place", "event_id", "origin", "tier", F.lit("EXACT").alias("kind"), F.col("claim_date").alias("day"), "live", "runs", "weight", F.col("claim_date").alias("last_seen"), (F.col("run").cast("bigint") * 1_000_000_000 + F.col("ref")).alias("seq")
    )
    known = F.col("event_id") % 3 != 0
    window = F.col("kind") == "WINDOW"
    published = d.release_events(spark, sf_dir).select(
        "event_id",
        F.when(known, F.when(window, "WINDOW").otherwise("EXACT")).alias("pub_kind"),
        F.when(known, F.when(window, F.col("window_start")).otherwise(F.col("updated_on"))).alias("pub_day"),
        F.when(known, F.when(window, F.col("window_end")).otherwise(F.col("updated_on"))).alias("pub_end"),
        F.when(known, F.col("status")).alias("pub_status"),
        (F.array(F.date_add("updated_on", 400), F.date_sub("updated_on", 400)) if schedule else F.lit(None).cast("array<date>")).alias("expected"),
    )
    return claims, published


_ROOT = "CASE {0}.origin WHEN 'scryfall' THEN 'wizards' WHEN 'ygoprodeck' THEN 'konami' WHEN 'bulbapedia' THEN 'pokemon' ELSE {0}.origin END"


def _gate_sql(near: int, shift: int, expected: bool, select: str) -> str:
    g8 = (
        f"""UNION ALL SELECT event_id, 2, rk, -runs, origin, seq, 0, 'G8', d, d, d FROM el JOIN con USING (event_id, seq) JOIN release_events USING (event_id)
        WHERE NOT bad AND (abs(d - (updated_on + 400)) <= {near} OR abs(d - (updated_on - 400)) <= {near})"""
        if expected
        else ""
    )
    return f"""
    SELECT {select} FROM (WITH cl AS (SELECT event_id, origin, tier, claim_date AS d, live, runs, CAST(run AS BIGINT) * 1000000000 + ref AS seq,
        greatest(0.0::DOUBLE, least(1.0::DOUBLE, weight * CASE tier WHEN 'OFFICIAL' THEN 1.0::DOUBLE WHEN 'RETAILER' THEN 0.7::DOUBLE WHEN 'COMMUNITY' THEN 0.45::DOUBLE ELSE 0.2::DOUBLE END)) AS w,
        CASE tier WHEN 'OFFICIAL' THEN 0 WHEN 'RETAILER' THEN 1 WHEN 'COMMUNITY' THEN 2 ELSE 3 END AS rk FROM claims),
    pub AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CASE kind WHEN 'WINDOW' THEN window_start ELSE updated_on END END AS pub_day, CASE WHEN event_id % 3 <> 0 THEN window_end END AS pub_end,
        CASE WHEN event_id % 3 <> 0 THEN status END AS pub_status FROM release_events),
    el AS (SELECT * FROM cl WHERE live AND tier <> 'SPECULATIVE'),
    con AS (SELECT a.event_id, a.seq, bool_or(b.origin <> a.origin AND abs(a.d - b.d) > {near}) AS bad FROM el a JOIN el b ON a.event_id = b.event_id GROUP BY 1, 2),
    prop AS (SELECT event_id, 0 AS p, rk AS t, -runs AS nr, origin AS k, seq AS i, 0 AS j, 'G1' AS rule, d, d AS lo, d AS hi FROM el WHERE tier = 'OFFICIAL'
      UNION ALL SELECT a.event_id, 1, least(a.rk, b.rk), -greatest(a.runs, b.runs), least(a.origin, b.origin) || '|' || greatest(a.origin, b.origin), a.seq, b.seq, 'G2', CASE WHEN a.rk <= b.rk THEN a.d ELSE b.d END, least(a.d, b.d), greatest(a.d, b.d)
        FROM el a JOIN el b ON a.event_id = b.event_id AND a.origin < b.origin AND abs(a.d - b.d) <= {near} AND {_ROOT.format("a")} <> {_ROOT.format("b")}
      UNION ALL SELECT event_id, 3, rk, -runs, origin, seq, 0, 'G3', d, d, d FROM el JOIN con USING (event_id, seq) WHERE tier = 'RETAILER' AND NOT bad AND runs >= 7 {g8}),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p, t, nr, k, i, j) AS n, max(hi) OVER (PARTITION BY event_id) - min(lo) OVER (PARTITION BY event_id) AS gap FROM prop) WHERE n = 1),
    ev AS (SELECT p.*, coalesce(n_live, 0) AS n_live, coalesce(n_all, 0) AS n_all, coalesce(n_el, 0) AS n_el, coalesce(bad, false) AS bad, seen, b.rule AS won, b.d AS won_day, b.gap,
        CASE WHEN b.d BETWEEN pub_day AND pub_end THEN NULL ELSE abs(pub_day - b.d) END AS moved
      FROM pub p LEFT JOIN (SELECT event_id, count(*) FILTER (live) AS n_live, count(*) AS n_all, max(d) AS seen FROM cl GROUP BY 1) c USING (event_id)
      LEFT JOIN (SELECT event_id, count(*) AS n_el FROM el GROUP BY 1) e USING (event_id) LEFT JOIN (SELECT event_id, bool_or(bad) AS bad FROM con GROUP BY 1) x USING (event_id) LEFT JOIN best b USING (event_id)),
    act AS (SELECT *, CASE WHEN n_live = 0 THEN 'STALE' WHEN won IS NULL THEN 'HOLD' WHEN gap > {near} OR moved > {shift} THEN 'FLAG' ELSE 'PUBLISH' END AS action,
      CASE WHEN n_live = 0 THEN 'G7' WHEN n_el = 0 THEN 'G4' WHEN won IS NULL THEN 'NONE' WHEN gap > {near} THEN 'G5' WHEN moved > {shift} THEN 'G6' ELSE won END AS rule FROM ev),
    settled AS (SELECT *, CASE action WHEN 'PUBLISH' THEN won_day ELSE pub_day END AS day FROM act),
    score AS (SELECT s.event_id, coalesce(bool_or(tier = 'OFFICIAL') FILTER (ok), false) AS official,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 - coalesce(product(1 - w) FILTER (ok), 1)) * power(0.7::DOUBLE, count(*) FILTER (NOT ok)))) AS c
      FROM (SELECT s.event_id, cl.*, cl.event_id IS NULL OR s.day IS NULL OR abs(cl.d - s.day) <= {near} AS ok FROM settled s LEFT JOIN cl ON cl.event_id = s.event_id) s GROUP BY s.event_id),
    scored AS (SELECT s.*, c, CASE WHEN official OR c >= 0.6::DOUBLE THEN 'CONFIRMED' WHEN c >= 0.3::DOUBLE THEN 'ANNOUNCED' ELSE 'RUMORED' END AS fresh FROM settled s JOIN score USING (event_id)),
    fin AS (SELECT *, n_live = 0 AND n_all > 0 AND DATE '{NOW}' - seen >= 14 AND (pub_day IS NULL OR pub_day > DATE '{NOW}') AND coalesce(pub_status, fresh) <> 'CANCELLED' AS cancels FROM scored)
    SELECT event_id, action, rule, CASE WHEN action = 'STALE' THEN CASE WHEN cancels THEN 'ABSENT_CANCELLED' ELSE 'ABSENT' END WHEN rule = 'G4' THEN 'SPECULATIVE_ONLY' WHEN action = 'HOLD' THEN CASE WHEN bad THEN 'CONTRADICTED' ELSE 'AWAITING_CORROBORATION' END
        WHEN rule = 'G5' THEN 'CONFLICT' WHEN rule = 'G6' THEN 'LARGE_SHIFT' WHEN rule = 'G1' THEN 'OFFICIAL_SINGLE' WHEN rule = 'G2' THEN 'INDEPENDENT_AGREEMENT' WHEN rule = 'G3' THEN 'RETAILER_STREAK' ELSE 'SCHEDULE_CORROBORATED' END AS reason,
      day, pub_day, pub_status, CASE WHEN action = 'STALE' THEN CASE WHEN cancels THEN 'CANCELLED' ELSE coalesce(pub_status, fresh) END WHEN action = 'PUBLISH' THEN CASE WHEN pub_status = 'RELEASED' AND day + 1 <= DATE '{NOW}' THEN 'RELEASED' ELSE fresh END ELSE coalesce(pub_status, 'RUMORED') END AS status,
      CAST(floor(c * 1e6::DOUBLE + 0.25::DOUBLE) AS BIGINT) AS micro, CAST(CASE rule WHEN 'G5' THEN gap WHEN 'G6' THEN moved END AS INTEGER) AS gap FROM fin) g"""


_VERDICT = "event_id, action, rule, reason, day, status, micro, gap"


def _shown(verdicts):
    return verdicts.select("event_id", "action", "rule", "reason", "day", "status", F.floor(F.col("confidence") * 1e6 + 0.25).cast("bigint").alias("micro"), "gap")


@query("gate_verdicts", _gate_sql(3, 14, False, _VERDICT), days=("day",))
def verdicts(spark, sf_dir):
    return _shown(gate.evaluate(*gate_inputs(spark, sf_dir), NOW))


@query("gate_verdicts_wide", _gate_sql(60, 400, True, _VERDICT), days=("day",))
def verdicts_wide(spark, sf_dir):
    """Wider tolerances and a schedule, so that every rule is met."""
    return _shown(gate.evaluate(*gate_inputs(spark, sf_dir, schedule=True), NOW, agreement=60, shift=400))


@query(
    "gate_diff",
    f"""SELECT event_id, action, rule, reason, pub_day AS day_before, day AS day_after, pub_status AS status_before, status AS status_after,
    CASE WHEN pub_status IS NULL THEN 'created' WHEN status = 'RELEASED' AND pub_status <> 'RELEASED' THEN 'released' WHEN status <> pub_status THEN 'status_changed' END AS notice
    FROM ({_gate_sql(3, 14, False, "*")}) v WHERE day IS DISTINCT FROM pub_day OR status IS DISTINCT FROM pub_status""", days=("day_before", "day_after"))
def run_diff(spark, sf_dir):
    claims, published = gate_inputs(spark, sf_dir)
    return gate.diff(gate.evaluate(claims, published, NOW), published)


@query("gate_summary", f"SELECT action, rule, count(*) AS n, CAST(count(*) FILTER (pub_status IS NULL) AS BIGINT) AS fresh FROM ({_gate_sql(3, 14, False, '*')}) v GROUP BY action, rule")
def summary(spark, sf_dir):
    claims, published = gate_inputs(spark, sf_dir)
    rows = gate.evaluate(claims, published, NOW).join(published.select("event_id", "pub_status"), "event_id")
    return rows.groupBy("action", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pub_status").isNull()).alias("fresh"))


_PARENTS = ", ".join(f"('{k}', {'NULL' if p is None else repr(p)})" for k, _, p in ORIGINS)


@query(
    "independent_origins",
    f"""WITH o AS (SELECT * FROM (VALUES {_PARENTS}) v(key, parent) WHERE key IN (SELECT origin FROM claims)) SELECT a.key AS a, b.key AS b FROM o a JOIN o b ON a.key < b.key WHERE coalesce(a.parent, a.key) <> coalesce(b.parent, b.key)""",
)
def independent_origins(spark, sf_dir):
    """Of the origins that claim anything, the pairs that don't copy from each other."""
    seen = settled(d.claims(spark, sf_dir).select("origin").distinct())
    pairs = independent(spark).join(seen.withColumnRenamed("origin", "a"), "a", "left_semi")
    return pairs.join(seen.withColumnRenamed("origin", "b"), "b", "left_semi").select("a", "b")


_GAME = "CASE install_id " + " ".join(f"WHEN {k} THEN '{g}'" for k, g in enumerate(GAMES)) + " END"
_SLOTS = "(VALUES " + ", ".join(f"('{g}', '{s}', {w}, {o})" for g, s, w, o in __import__("tidemark.schema", fromlist=["SLOTS"]).SLOTS) + ") s(game, slot, weekday, occurrence)"
_EXPECTED = f"""SELECT event_id, set_id, region, slot, day, day - CAST(CASE WHEN (dayofweek(day) - weekday + 7) % 7 = 0 THEN 7 ELSE (dayofweek(day) - weekday + 7) % 7 END + 7 * (occurrence - 1) AS INTEGER) AS expected
    FROM (SELECT event_id, set_id, region, date_exact AS day, {_GAME} AS game FROM release_events JOIN product_sets USING (set_id) WHERE type = 'SHELF' AND status IN ('CONFIRMED', 'RELEASED') AND kind = 'EXACT' AND NOT archived) a JOIN {_SLOTS} USING (game)"""


def anchors(spark, sf_dir):
    events = d.release_events(spark, sf_dir).where("type = 'SHELF' AND status IN ('CONFIRMED', 'RELEASED') AND kind = 'EXACT' AND NOT archived")
    return events.join(d.product_sets(spark, sf_dir), "set_id").select("event_id", "set_id", "region", F.col("date_exact").alias("day"), d.pick(F.col("install_id"), *GAMES).alias("game"))


@query("derived_prereleases", f"SELECT event_id, set_id, region, slot, expected FROM ({_EXPECTED}) x WHERE day - expected BETWEEN 1 AND 21", days=("expected",))
def derived(spark, sf_dir):
    return derive.occurrences(anchors(spark, sf_dir)).select("event_id", "set_id", "region", "slot", "expected")


@query(
    "derived_standing",
    f"""SELECT event_id, slot FROM ({_EXPECTED}) x WHERE NOT EXISTS (SELECT 1 FROM release_events p WHERE p.type = 'PRERELEASE' AND p.kind = 'EXACT' AND p.set_id = x.set_id AND p.region = x.region AND abs(p.date_exact - x.expected) <= 3)""",
)
def standing(spark, sf_dir):
    sourced = d.release_events(spark, sf_dir).where("type = 'PRERELEASE' AND kind = 'EXACT'").select("set_id", "region", F.col("date_exact").alias("day"))
    return derive.stand_down(derive.occurrences(anchors(spark, sf_dir)), sourced).select("event_id", "slot")


@query(
    "derived_reconciliation",
    f"""WITH w AS (SELECT event_id, slot, expected FROM ({_EXPECTED}) x), e AS (SELECT event_id, slot, expected + CAST(event_id % 3 AS INTEGER) AS expected FROM ({_EXPECTED.replace("IN ('CONFIRMED', 'RELEASED')", "IN ('CONFIRMED', 'CANCELLED')")}) y)
    SELECT event_id, slot, e.expected AS before, w.expected AS after, CASE WHEN e.expected IS NULL THEN 'insert' WHEN w.expected IS NULL THEN 'archive' WHEN e.expected = w.expected THEN 'keep' ELSE 'update' END AS action
    FROM w FULL JOIN e USING (event_id, slot)""", days=("before", "after"))
def reconciliation(spark, sf_dir):
    wanted = derive.occurrences(anchors(spark, sf_dir))
    events = d.release_events(spark, sf_dir).where("type = 'SHELF' AND status IN ('CONFIRMED', 'CANCELLED') AND kind = 'EXACT' AND NOT archived")
    old = events.join(d.product_sets(spark, sf_dir), "set_id").select("event_id", F.col("date_exact").alias("day"), d.pick(F.col("install_id"), *GAMES).alias("game"))
    existing = derive.occurrences(old).withColumn("expected", F.expr("date_add(expected, cast(event_id % 3 as int))"))
    return derive.reconcile(wanted, existing, ["event_id", "slot"], "expected")


@query(
    "release_lifecycle",
    f"""SELECT event_id, 'RELEASED' AS status, DATE '{NOW}' - (coalesce(date_exact, date_end) + 1) < 3 AS recent, type = 'SHELF' AS notify FROM release_events
    WHERE NOT archived AND NOT is_override AND status IN ('ANNOUNCED', 'CONFIRMED') AND kind IN ('EXACT', 'RANGE') AND coalesce(date_exact, date_end) + 1 <= DATE '{NOW}'""",
)
def released(spark, sf_dir):
    return derive.lifecycle(d.release_events(spark, sf_dir), NOW)


@query(
    "name_similarity",
    """WITH n AS (SELECT DISTINCT name FROM product_sets), t AS (SELECT name, unnest(list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('set', 'box', 'pack', 'case')))) AS w FROM n),
    k AS (SELECT name, count(*) AS k FROM t GROUP BY name)
    SELECT a, b, CAST(floor(2.0::DOUBLE * shared / (x.k + y.k) * 1e6::DOUBLE + 0.25::DOUBLE) AS BIGINT) AS micro FROM (SELECT p.name AS a, q.name AS b, count(*) AS shared FROM t p JOIN t q ON p.w = q.w AND p.name < q.name GROUP BY 1, 2) s JOIN k x ON x.name = a JOIN k y ON y.name = b""",
)
def name_similarity(spark, sf_dir):
    from tidemark.functions.text import tokens

    names = settled(d.product_sets(spark, sf_dir).select("name").distinct().withColumn("w", F.explode(tokens(F.col("name")))))
    pairs = names.alias("p").join(names.alias("q"), F.expr("p.w = q.w AND p.name < q.name")).select(F.col("p.name").alias("a"), F.col("q.name").alias("b")).distinct()
    return pairs.select("a", "b", F.floor(identity.similarity(F.col("a"), F.col("b")) * 1e6 + 0.25).cast("bigint").alias("micro"))


def identity_inputs(spark, sf_dir):
    parts = d.product_sets(spark, sf_dir).withColumn("game", d.pick(F.col("install_id"), *GAMES))
    sets = parts.where("set_id % 2 = 0").select(F.col("set_id").cast("string").alias("set_id"), "game", "name", "code", F.lit(False).alias("synthetic"), F.col("set_id").alias("created"))
    candidates = parts.where("set_id % 2 = 1").select(
        F.col("set_id").cast("string").alias("candidate_id"), "game", F.lit("tcgplayer").alias("origin"), "name", F.when(F.expr("size % 3 = 0"), F.col("code")).alias("code"), F.create_map(F.lit("tcgplayer"), (F.col("set_id") % 50).cast("string")).alias("external_ids")
    )
    identities = spark.createDataFrame([("tcgplayer", str(k), str(2 * k)) for k in range(10)], "origin string, external_id string, set_id string")
    return candidates, sets, identities


_WORDS, _ORIGINS = ["dawn", "dusk", "tide", "reign"], ["bulbapedia", "scryfall", "tcgplayer"]
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

_RUN = f"""p AS (SELECT *, set_id // 2 AS h, CASE WHEN set_id // 2 % 5 = 0 THEN name || ' ' || lower(string_split(code, '-')[2]) || ' ' || {_WORDS}[1 + set_id // 2 % 4] ELSE name END AS said, CASE WHEN size % 3 = 0 THEN 'K' || set_id // 2 % 211 END AS own FROM product_sets),
  w AS (SELECT *, list_sort(list_distinct(list_filter(string_split(lower(said), ' '), lambda x: x NOT IN ({_STOPS})))) AS t FROM p),
  c AS (SELECT install_id AS game, CAST(set_id AS VARCHAR) AS cid, {_ORIGINS}[1 + h % 3] AS origin, said, t, own, list_concat(CASE WHEN h % 2 = 0 THEN [{_ORIGINS}[1 + h % 3] || '=' || set_id % 301] ELSE [] END, CASE WHEN set_id % 3 = 0 THEN [{_ORIGINS}[1 + (h + 1) % 3] || '=' || set_id * 7 % 301] ELSE [] END) AS ids FROM w WHERE set_id % 2 = 1),
  amb AS (SELECT DISTINCT game, own FROM c WHERE own IS NOT NULL GROUP BY game, origin, own HAVING count(DISTINCT said) > 1),
  cand AS (SELECT c.*, c.own IS NOT NULL AND amb.own IS NULL AS clear, row_number() OVER (PARTITION BY c.game ORDER BY cid) AS k FROM c LEFT JOIN amb ON amb.game = c.game AND amb.own = c.own),
  pinned AS (SELECT map_from_entries(list((id, sid))) AS pins FROM (SELECT 'tcgplayer=' || set_id // 20 AS id, CAST(set_id AS VARCHAR) AS sid FROM p WHERE set_id % 20 = 0)),
  stored AS (SELECT install_id AS game, list({{'place': set_id, 'sid': CAST(set_id AS VARCHAR), 't': t, 'own': own}} ORDER BY set_id) AS sets FROM w WHERE set_id % 2 = 0 GROUP BY install_id),
  fold AS (SELECT game, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS cid, CAST(NULL AS VARCHAR) AS set_id, CAST(NULL AS VARCHAR) AS matched_by, sets, CASE WHEN game = 0 THEN pins ELSE map_from_entries(list_filter(map_entries(pins), lambda e: false)) END AS pins FROM stored, pinned
    UNION ALL
    SELECT game, k, cid, set_id, matched_by, CASE WHEN matched_by = 'new' THEN list_append(sets, {{'place': 1000000000 + k, 'sid': set_id, 't': t, 'own': CASE WHEN clear AND len(coded) = 0 THEN own END}}) ELSE sets END AS sets,
      CASE WHEN len(ids) = 0 THEN pins ELSE map_concat(map(ids, list_transform(ids, lambda i: set_id)), pins) END AS pins
    FROM (SELECT *, coalesce(by_id, by_code, by_name, made) AS set_id, CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_code IS NOT NULL THEN 'code' WHEN by_name IS NOT NULL THEN 'name' ELSE 'new' END AS matched_by
      FROM (SELECT *, list_filter(list_transform(ids, lambda i: pins[i]), lambda x: x IS NOT NULL)[1] AS by_id, CASE WHEN clear AND len(coded) = 1 THEN coded[1].sid END AS by_code,
          list_sort(list_filter(list_transform(sets, lambda s: {{'far': -CASE WHEN s.t = t THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(s.t, t)) / (len(s.t) + len(t)) END, 'place': s.place, 'sid': s.sid, 'open': own IS NULL OR s.own IS NULL OR own = s.own}}), lambda m: m.far <= -0.75 AND m.open))[1].sid AS by_name
        FROM (SELECT cand.*, fold.sets, fold.pins, list_filter(fold.sets, lambda s: s.own = cand.own) AS coded, 'new-' || left(sha256({{GAMES}}[1 + cand.game] || '|' || cand.cid), 12) AS made FROM fold JOIN cand ON cand.game = fold.game AND cand.k = fold.k + 1))))""".replace("{GAMES}", str(GAMES))


def identity_run(spark, sf_dir):
    """Half of the sets are stored, the others come as sightings of three origins: some with an id of their own or a foreign one, some with a code, names that share words."""
    half, of = F.expr("set_id div 2"), lambda k: d.pick(k % 3, *_ORIGINS)
    said = F.when(half % 5 == 0, F.concat_ws(" ", "name", F.lower(F.split("code", "-")[1]), d.pick(half % 4, *_WORDS))).otherwise(F.col("name"))
    parts = d.product_sets(spark, sf_dir).select(
        "set_id", d.pick(F.col("install_id"), *GAMES).alias("game"), said.alias("name"), F.when(F.expr("size % 3 = 0"), F.concat(F.lit("K"), (half % 211).cast("string"))).alias("code"), of(half).alias("origin"), of(half + 1).alias("next")
    )
    sets = parts.where("set_id % 2 = 0").select(F.col("set_id").cast("string").alias("set_id"), "game", "name", "code", F.lit(False).alias("synthetic"), F.col("set_id").alias("created"))
    own = F.when(half % 2 == 0, F.struct(F.col("origin").alias("key"), (F.col("set_id") % 301).cast("string").alias("value")))
    foreign = F.when(F.col("set_id") % 3 == 0, F.struct(F.col("next").alias("key"), (F.col("set_id") * 7 % 301).cast("string").alias("value")))
    ids = F.map_from_entries(F.filter(F.array(own, foreign), lambda e: e.isNotNull()))
    candidates = parts.where("set_id % 2 = 1").select(F.col("set_id").cast("string").alias("candidate_id"), "game", "origin", "name", "code", ids.alias("external_ids"))
    identities = parts.where("set_id % 20 = 0").select(F.lit("tcgplayer").alias("origin"), F.expr("set_id div 20").cast("string").alias("external_id"), F.col("set_id").cast("string").alias("set_id"))
    return candidates, sets, identities


@query("identity_resolution", f"WITH RECURSIVE {_RUN} SELECT cid AS candidate_id, set_id, matched_by FROM fold WHERE k > 0")
def resolution(spark, sf_dir):
    return identity.resolve_in_order(*identity_run(spark, sf_dir)).select("candidate_id", "set_id", "matched_by")


@query("identity_outcomes", f"WITH RECURSIVE {_RUN} SELECT {GAMES}[1 + game] AS game, CAST(sum(n) AS BIGINT) AS candidates, count(*) AS sets, CAST(sum(paired) AS BIGINT) AS paired FROM (SELECT game, fold.set_id, count(*) AS n, CAST(min(origin) <> max(origin) AS INTEGER) AS paired FROM fold JOIN c USING (game, cid) GROUP BY ALL) GROUP BY game")
def identity_outcomes(spark, sf_dir):
    """Per game, how many candidates came, how many sets they made up, and how many of these two origins met in."""
    return identity.outcomes(identity.resolve_in_order(*identity_run(spark, sf_dir)))


@query("similar_names", f"WITH p AS (SELECT DISTINCT install_id AS game, name || ' ' || lower(string_split(code, '-')[2]) || ' ' || {_WORDS}[1 + set_id // 2 % 4] AS name FROM product_sets), w AS (SELECT game, name, list_distinct(list_filter(string_split(name, ' '), lambda x: x NOT IN ({_STOPS}))) AS t FROM p), m AS (SELECT a.game, a.name AS x, b.name AS y, CASE WHEN list_sort(a.t) = list_sort(b.t) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)) END AS score FROM w a JOIN w b ON a.game = b.game AND a.name < b.name) SELECT {GAMES}[1 + game] AS game, x, y, CAST(floor(score * 1e6::DOUBLE + 0.25::DOUBLE) AS BIGINT) AS micro FROM m WHERE score >= 0.75")
def similar_names(spark, sf_dir):
    """Pairs of names over the threshold, met in their rarest words."""
    said = F.concat_ws(" ", "name", F.lower(F.split("code", "-")[1]), d.pick(F.expr("set_id div 2") % 4, *_WORDS))
    names = d.product_sets(spark, sf_dir).select(d.pick(F.col("install_id"), *GAMES).alias("game"), said.alias("name")).distinct()
    return identity.name_pairs(names, names).where("x < y").select("game", "x", "y", F.floor(F.col("score") * 1e6 + 0.25).cast("bigint").alias("micro"))


def replay_inputs(spark, sf_dir):
    """The sightings of `identity_run` as payloads of 500 sets each, how they are parsed, and the stores before the run. A sighting without an id is known by its own, and ids are those of a game."""
    from tidemark.sources import payloads

    candidates, sets, identities = identity_run(spark, sf_dir)
    own = F.create_map(F.col("origin"), F.concat(F.lit("c"), "candidate_id"))
    own_game = lambda game, value: F.concat_ws(":", game, value)
    rows = candidates.withColumn("external_ids", F.transform_values(F.when(F.size("external_ids") > 0, F.col("external_ids")).otherwise(own), lambda _, v: own_game(F.col("game"), v)))
    identities = identities.join(sets.select("set_id", "game"), "set_id").select("origin", own_game(F.col("game"), F.col("external_id")).alias("external_id"), "set_id")
    part = F.expr("cast(candidate_id as bigint) div 500").alias("part")
    bodies = rows.groupBy("game", part).agg(F.to_json(F.collect_list(F.struct("candidate_id", "origin", "name", "code", "external_ids"))).alias("text"))
    packed = payloads.pack(bodies, "text")
    schema = "array<struct<candidate_id: string, origin: string, name: string, code: string, external_ids: map<string,string>>>"

    def parse(rows):
        items = payloads.unpacked(rows.select("game", "body")).select("game", F.explode(F.from_json("text", schema)).alias("c")).select("game", "c.*")
        day = F.expr("date_add(date'2024-01-01', cast(cast(candidate_id as bigint) % 300 as int))")
        return items.withColumns({"type": F.lit("SHELF"), "region": F.lit("GLOBAL"), "day": day})

    none = lambda schema: spark.createDataFrame([], schema)
    stores = replay.Stores(sets, identities, none("run string, origin string, set_id string, type string, region string, day date"), none("run string, game string, candidates long, sets long, paired long, payloads long"))
    return settled(packed), parse, stores


@query("run_replayed", f"WITH RECURSIVE {_RUN}, r AS (SELECT game, cid, fold.set_id, matched_by, origin FROM fold JOIN c USING (game, cid)), s AS (SELECT game, set_id, count(*) AS n, min(origin) <> max(origin) AS paired, count(DISTINCT origin) AS claims FROM r GROUP BY ALL) SELECT {GAMES}[1 + game] AS game, CAST(sum(n) AS BIGINT) AS candidates, count(*) AS sets, CAST(sum(CAST(paired AS INTEGER)) AS BIGINT) AS paired, CAST(sum(claims) AS BIGINT) AS claims, (SELECT count(*) FROM r WHERE r.game = s.game AND matched_by = 'new') AS made FROM s GROUP BY game")
def run_replayed(spark, sf_dir):
    """A run out of its payloads, and once more: the notes, claims and sets that are stored in the end are those of one time."""
    packed, parse, stores = replay_inputs(spark, sf_dir)
    before = stores.sets
    for _ in range(2):
        stores = replay.replay(packed, "run-1", parse, stores)
    claims = stores.claims.join(stores.sets.select("set_id", "game"), "set_id").groupBy("game").agg(F.count(F.lit(1)).alias("claims"))
    made = stores.sets.join(before.select("set_id"), "set_id", "left_anti").groupBy("game").agg(F.count(F.lit(1)).alias("made"))
    return stores.runs.join(claims, "game", "left").join(made, "game", "left").select("game", "candidates", "sets", "paired", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("made", F.lit(0)).alias("made"))
