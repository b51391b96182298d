"""Steps that must not grow faster than their input, and results that must not hang on how Spark deals rows out."""

from datetime import date
from itertools import permutations

from pyspark.sql import functions as F

from tidemark.operators import calendar, claims, gate, identity
from tidemark.plans.registry import QUERIES
from tidemark.sources import mappers, payloads


def test_recipients_are_counted_once_without_pairs_of_events_and_subscribers(spark):
    """Repeated rows, users of two installs, unknown installs and missing users count as in a union of pairs; the subscribers of an install are gone through once, not once per event."""
    df = spark.createDataFrame
    followed = df([(e, e % 2) for e in range(40)] + [(0, 0), (1, 0), (50, None), (51, 9)], "event_id long, install_id int")
    subscribers = df([(u % 3, u) for u in range(300)] + [(0, 1), (0, 0), (1, None)], "install_id int, user_id long")
    loved = df([(e, u) for e in (0, 1, 51, 60) for u in (0, 1, 2, 2, 1000, None)], "event_id long, user_id long")
    pairs = {(e, u) for e, i in {tuple(r) for r in followed.collect()} for j, u in map(tuple, subscribers.collect()) if i is not None and i == j} | {tuple(r) for r in loved.collect()}
    want = {e: sum(x == e for x, _ in pairs) for e, _ in pairs}
    rows = calendar.recipients(followed, subscribers, loved)
    assert {r.event_id: r.recipients for r in rows.collect()} == want
    joins = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "installs" in joins and joins.count("collect_set") >= 1


def _product(factors):
    out = 1.0
    for f in factors:
        out *= f
    return 1 - out


#: Weights of three claims whose product hangs on the order.
WEIGHTS = [("RETAILER", 0.95), ("COMMUNITY", 0.9), ("OFFICIAL", 0.95)]


def _orders():
    rate = {"RETAILER": 0.7, "COMMUNITY": 0.45, "OFFICIAL": 1.0}
    want = {}
    for k, order in enumerate(permutations(range(3))):
        want[k] = order, _product(1 - WEIGHTS[i][1] * rate[WEIGHTS[i][0]] for i in order)
    assert len({c for _, c in want.values()}) > 1
    return want


def test_noisy_or_multiplies_in_the_order_of_the_table(spark):
    want = _orders()
    rows = [(e, order.index(i), *WEIGHTS[i]) for e, (order, _) in want.items() for i in (2, 0, 1)]
    df = spark.createDataFrame(rows, "event_id int, place long, tier string, weight double").repartition(5)
    got = df.groupBy("event_id").agg(claims.noisy_or(F.col("tier"), F.col("weight"), F.col("place")).alias("c")).collect()
    assert {r.event_id: r.c for r in got} == {e: c for e, (_, c) in want.items()}


def test_the_gate_multiplies_in_the_order_of_the_table(spark):
    want = _orders()
    names = ["tcgplayer", "wikipedia", "bandai"]
    rows = [((f"{order.index(i)}", order.index(i)), e, names[i], WEIGHTS[i][0], "EXACT", date(2026, 6, 1), True, 1, WEIGHTS[i][1], date(2026, 6, 1), i) for e, (order, _) in want.items() for i in (2, 0, 1)]
    df = spark.createDataFrame(rows, "place struct<file: string, row: long>, event_id int, origin string, tier string, kind string, day date, live boolean, runs int, weight double, last_seen date, seq long").repartition(5)
    published = spark.createDataFrame([(e, None, None, None, None, None) for e in [*want, 99]], "event_id int, pub_kind string, pub_day date, pub_end date, pub_status string, expected array<date>")
    got = {r.event_id: r.confidence for r in gate.evaluate(df, published, "2026-05-20").collect()}
    assert got == {e: c for e, (_, c) in want.items()} | {99: 0.0}


def test_payloads_are_taken_apart_as_a_stream(spark):
    """Values, several to a row and none; the steps are streams and no functions of whole batches."""
    rows = spark.range(100).coalesce(1).select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"))
    sizes = payloads.streamed(rows, "text", "n", "int", len)
    assert {r.id: r.n for r in sizes.collect()} == {k: 1 + len(str(k)) for k in range(100)}
    each = payloads.streamed(rows, "text", "c", "string", list, many=True)
    assert sorted((r.id, r.c) for r in each.collect()) == sorted((k, c) for k in range(100) for c in f"x{k}")
    plan = mappers.blocks(rows, "text", ".row", [".name"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "PythonUDF" not in plan
    for out in (payloads.pack(rows, "text"), payloads.unpacked(payloads.pack(rows, "text"))):
        assert "PythonUDF" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_claim_streaks_shuffle_once(spark, sf):
    text = QUERIES["claim_streaks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_names_meet_sets_by_classes_and_not_by_candidates(spark):
    """Candidates that share a name and a code are matched once; each still gets the set, a repeated id the best of its rows, and a missing code vetoes nothing."""
    sets = spark.createDataFrame([("s1", "g", "Dark Tide Storm", "AB1", False, 2), ("s2", "g", "Dark Tide Storm", None, False, 1), ("s3", "g", "Dark Tide Storm", "CD2", False, 0)], "set_id string, game string, name string, code string, synthetic boolean, created long")
    rows = [(f"a{k}", "g", "Dark Tide Storm", "AB1") for k in range(5)] + [(f"n{k}", "g", "Dark Tide Storm", None) for k in range(5)] + [("a0", "g", "Dark Tide Storm", None), ("x", "g", "Dark Tide Storm", "EF3"), ("y", "h", "Dark Tide Storm", None)]
    got = {r.candidate_id: (r.set_id, r.score) for r in identity.by_name(spark.createDataFrame(rows, "candidate_id string, game string, name string, code string"), sets).collect()}
    assert got == {"a0": ("s3", 1.0), **{f"a{k}": ("s2", 1.0) for k in range(1, 5)}, **{f"n{k}": ("s3", 1.0) for k in range(5)}, "x": ("s2", 1.0)}
