"""Periodic runs against a search of every period, and the query against a plain version of its whole contract."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import runs
from tidemark.llm.common import documents


def plain(w):
    """Every maximal stretch of every period, those of a smaller period left out."""
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                found.setdefault((s, i + q - s), q)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain(w)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in drop)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 9), st.integers(0, 5)), min_size=1, max_size=6))
def test_repeated_pieces(pieces):
    w = [x for block, times, more in pieces for x in block * times + block[:more]]
    assert runs.periodic_runs(w) == plain(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=300))
def test_two_letters(w):
    assert runs.periodic_runs(w) == plain(w)


@pytest.mark.parametrize("period", range(1, 70))
def test_each_period_at_the_least_length(period):
    """At the bound, one word below it, and with a copy of the period as a word away."""
    rnd = random.Random(period)
    block = [rnd.randrange(10_000) for _ in range(period)]
    least = max(24, 3 * period)
    for shift in (0, 1, 5, 13):
        for length in (least - 1, least, least + 1):
            w = [-i - 1 for i in range(shift)] + (block * (least + 1))[:length] + [-100, -101]
            assert runs.periodic_runs(w) == plain(w) == ([] if length < least else [(shift, length, period)])


def test_nested_and_touching_runs():
    unit = [1] * 30 + [2]
    for w in (unit * 4, unit * 2, [1] * 40 + [2] * 40, ([3] + [1, 2] * 20) * 3 + [3], [*range(10)] * 3 + [*range(5, 15)] * 3, [0] * 1000):
        assert runs.periodic_runs(w) == plain(w)


def test_a_long_text_of_one_word():
    assert runs.periodic_runs(["x"] * 300_000) == [(0, 300_000, 1)]


def test_strongest_breaks_ties_by_start_then_period():
    assert runs.strongest([(50, 30, 10), (5, 24, 8), (5, 30, 10)]) == (5, 24, 8)
    assert runs.strongest([]) is None


def test_odd_and_empty_tables(odd, none):
    more = odd.selectExpr("*", "1 as runs", "'s' as strongest", "2 as n_words")
    got = runs.find_runs(more)
    assert sorted(got.columns) == sorted([*odd.columns, "n_words", "runs", "strongest", "collapsed"])
    want = sorted(plain(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd.collect())
    assert sorted([tuple(x) for x in r.runs] for r in got.collect()) == want
    assert runs.find_runs(none).count() == 0


def test_rows_of_odd_ids(spark):
    text = " ".join(["a b c d e f g"] * 12)
    data = [(None, text), (None, None), (7, text), (7, text), (10, ""), (11, " \t\n"), (12, text + "\x1c  x"), (20, "one two three")]
    data += [(i, " ".join(random.Random(i).choice("abcdefgh") for _ in range(200))) for i in range(100, 180)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(map(str, _digests(docs)))
    assert got == sorted(str(plain_row(*r)) for r in data)


def _digests(docs, monkey=pytest.MonkeyPatch):
    with monkey.context() as m:
        m.setattr(runs, "documents", lambda spark, sf_dir: docs)
        return [tuple(r) for r in runs.op12_periodic_runs(docs.sparkSession, "").collect()]


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    got = runs.op12_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_row(*r) for r in rows)
    assert any(r.n_runs for r in got.collect())
