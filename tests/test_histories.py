"""Histories in order against plain loops."""

import random

import pytest

from tidemark.operators import limits


@pytest.mark.parametrize("seed", range(3))
def test_rate_limit_against_a_loop(spark, seed):
    """Pauses, ties, a key without hits allowed for long, a null key."""
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, 1, 1, 1, 2, 3]), k, rnd.randrange(0, 3000) if k % 3 else rnd.randrange(0, 200)) for k in range(400)]
    table = spark.createDataFrame([(u, k, t) for u, k, t in rows], "u long, k long, t long").selectExpr("u", "k", "timestamp_seconds(t) AS at")
    got = {r.k: r.allowed for r in limits.rate_limited(table, "u", "at", "k", 3, 60).collect()}
    kept, want = {}, {}
    for u, k, t in sorted(rows, key=lambda r: (r[2], r[1])):
        last = [x for x in kept.get(u, []) if t - x < 60]
        want[k] = len(last) < 3
        kept[u] = last + [t] * want[k]
    assert got == want and not all(want.values())


def test_crawl_against_a_queue(spark):
    rnd = random.Random(2)
    links = [(p, k, rnd.randrange(45)) for p in range(40) for k in range(rnd.randrange(2, 6))]
    seeds = [("a", 0, 0), ("a", 7, 1), ("b", 3, 0), ("c", 44, 0)]
    known = range(40)
    out = limits.crawl(spark.createDataFrame(links, "page long, position int, target long"), spark.createDataFrame(seeds, "site string, page long, position int"), spark.createDataFrame([(p,) for p in known], "page long"), 12, 20)
    want = []
    for site in "abc":
        queue, seen = [(p, 0, None) for s, p, _ in seeds if s == site], {}
        while queue and len(seen) < 12:
            p, d, parent = queue.pop(0)
            if p in seen:
                continue
            seen[p] = (site, p, d, parent, len(seen) + 1, p in known)
            if p in known:
                queue += [(t, d + 1, p) for q, _, t in sorted(links) if q == p]
        want += seen.values()
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) >= 20


@pytest.mark.parametrize("seed", range(3))
def test_slugs_against_a_loop(spark, seed):
    """Bases that are another's base and code, stored slugs, empty bases, and a clash with a fallback."""
    rnd = random.Random(seed)
    parts = ["a", "b", "a-b", "b-a", "a-b-a", "", "c"]
    sets = [(rnd.randrange(2), k, rnd.choice(parts), rnd.choice(["a", "b", "", "c-a", None])) for k in range(80)]
    stored = [(0, "a"), (1, "b-a"), (0, "set")]
    got = {(r.install_id, r.set_id): r.slug for r in limits.unique_slugs(spark.createDataFrame(sets, "install_id int, set_id long, base string, code string"), spark.createDataFrame(stored, "install_id int, slug string")).collect()}
    import hashlib

    taken, want = set(stored), {}
    for i, k, base, code in sorted(sets, key=lambda s: s[1]):
        spare = f"{base or 'set'}-{hashlib.sha256(f'{i}|{k}'.encode()).hexdigest()[:6]}"
        coded = "-".join(x for x in (base, code) if x) if code else None
        want[i, k] = next(c for c in (base, coded, spare, f"{spare}-{k}") if c and (i, c) not in taken)
        taken.add((i, want[i, k]))
    assert got == want and len({(i, s) for (i, _), s in got.items()}) == len(sets)
    assert any(s.count("-") and len(s.split("-")[-1]) == 6 for s in got.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "install_id int, set_id long, base string, code string, slug string")
    assert limits.unique_slugs(none, none).count() == 0
    hits = spark.createDataFrame([], "u long, k long, at timestamp, provider string, ok boolean")
    assert limits.rate_limited(hits, "u", "at", "k", 3, 60).count() == 0 and limits.alarm_history(hits, "2024-01-01").count() == 0


def test_companions_take_their_parents_date_in_one_game(spark):
    from tidemark.sources import mappers

    rows = [(g, k, n, "", p, s, k) for g in ("magic-the-gathering", "pokemon-tcg") for k, n, p, s in [(1, "The Hobbit", "2026-05-01T00:00:00", False), (2, "the hobbit", "2026-06-01T00:00:00", False), (3, "Art Series: The Hobbit", "2026-09-09T00:00:00", True), (4, "Art Series: Unknown", "2026-09-09T00:00:00", True), (5, "The Hobbit", "2026-07-01T20:00:07.1Z", False)]]
    groups = spark.createDataFrame(rows, "game string, group_id long, name string, code string, published string, supplemental boolean, place int").selectExpr("*", "date'2026-04-01' AS fetched")
    day = {(r.game[:5], r.group_id): str(r.day) for r in mappers.retail_groups(groups, "fetched", "place").collect()}
    assert day["magic", 3] == "2026-06-01" and day["pokem", 3] == "2026-09-09" and day["magic", 4] == day["pokem", 4] == "2026-09-09" and ("magic", 5) not in day
    broken = groups.unionByName(groups.limit(1).selectExpr("'pokemon-tcg' AS game", "9L AS group_id", "'X' AS name", "'' AS code", "'someday' AS published", "false AS supplemental", "9 AS place", "fetched"))
    assert [(r.path, r.message) for r in mappers.retail_failures(broken, "fetched").collect()] == [("pokemon-tcg.results.9.publishedOn", 'unparseable date "someday"')]
    assert mappers.retail_groups(broken, "fetched", payload="fetched").count() == 0


def test_spans_around_open_cells():
    from tidemark.sources.payloads import grid_of

    one = lambda *texts: [(t, 1, 1) for t in texts]
    assert grid_of([[("a", 2, 1), ("b", 1, 1)], one("c")]) == [["a", "b"], ["a", "c"]]
    assert grid_of([[("a", 9, 1), *one("b")], one("c")]) == [["a", "b"], ["a", "c"]]
    # a cell over two columns goes around one that is open between them; a row of carried cells alone stays; an empty row is none
    assert grid_of([[*one("a"), ("b", 3, 1), *one("c")], [("w", 1, 2)], [], one("z")]) == [["a", "b", "c"], ["w", "b", "w"], ["z", "b", ""]]
    assert grid_of([[("a", 2, 2)], [], one("x")]) == [["a", "a"], ["a", "a"], ["x", ""]]
    assert grid_of([]) == grid_of([[], []]) == []


def test_state_from_run_to_run(spark):
    """Same date, another date, silence, and a return; three runs."""
    from datetime import date

    from tidemark.operators import claims

    a, b = date(2026, 1, 1), date(2026, 2, 2)
    runs = [[(1, "x", a), (2, "x", a), (3, "x", None)], [(1, "x", a), (1, "y", b), (3, "x", None)], [(1, "x", b), (2, "x", a), (2, "x", None)]]
    schema = "event_id long, origin string, claim_date date"
    state = claims.first_state(spark.createDataFrame([], schema))
    for rows in runs:
        state = claims.advanced(state, spark.createDataFrame(rows, schema))
    got = {(r.event_id, r.origin): (r.claim_date, r.streak, r.missed) for r in state.collect()}
    assert got == {(1, "x"): (b, 1, 0), (1, "y"): (b, 1, 1), (2, "x"): (a, 2, 0), (3, "x"): (None, 2, 1)}


def test_replay_converges_and_a_retry_adds_what_is_new(spark, sf):
    """Half of the payloads, then all, then all again: as all at once where nothing depends on the order, and the last time nothing changes."""
    from tidemark.operators.replay import replay
    from tidemark.plans.decisions import replay_inputs

    packed, parse, stores = replay_inputs(spark, sf)
    kinds = ("sets", "identities", "claims", "runs")
    rows = lambda s: [sorted(map(str, getattr(s, k).collect())) for k in kinds]
    once = replay(packed, "r", parse, stores)
    again = replay(packed, "r", parse, once)
    assert rows(once) == rows(again)
    assert once.sets.count() == once.sets.select("set_id").distinct().count() and once.identities.count() == once.identities.select("origin", "external_id").distinct().count()
    other = replay(packed.where("game = 'pokemon-tcg'"), "r", parse, stores)
    later = replay(packed, "r", parse, other)
    assert rows(later)[:3] == rows(once)[:3]
