import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, mixing


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize(("bits", "piece"), [(64, 10_000), (2, 1)])
def test_report_against_brute_force(odd, monkeypatch, bits, piece):
    """Also with hashes of two bits, of which chains are made."""
    monkeypatch.setattr(exact_dedup, "PIECE", piece)
    got = exact_dedup.dedup_report(odd, bits=bits).collect()
    texts = [(r.doc_id, lower(r.text)) for r in odd.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    assert len(got) == len(texts)
    want = Counter((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    assert (max(r.chain for r in got) > 1) == (bits == 2)


def test_small_buckets_give_the_same(odd):
    a = exact_dedup.dedup_report(odd, bucket_capacity=1)
    assert a.select("bucket").distinct().count() > 1
    key = lambda r: (r.doc_id is None, r.doc_id, r.text_sha256, r.kept)
    assert sorted(map(key, a.collect())) == sorted(map(key, exact_dedup.dedup_report(odd).collect()))


@pytest.mark.parametrize(("bits", "capacity"), [(64, 250_000), (64, 1), (2, 1)])
def test_drop_copies_keeps_columns_and_one_row_each(odd, bits, capacity):
    left = exact_dedup.drop_copies(odd, capacity, bits)
    assert left.columns == odd.columns
    last = {}
    for r in odd.collect():
        last[lower(r.text)] = max(-1 if r.doc_id is None else r.doc_id, last.get(lower(r.text), -1))
    assert Counter((lower(r.text), -1 if r.doc_id is None else r.doc_id) for r in left.collect()) == Counter({k: 1 for k in last.items()})


def test_index_lies_on_files_by_bucket(odd):
    index = exact_dedup.build_index(odd, bucket_capacity=2)
    folders = {f.split("bucket=")[1].split("/")[0] for f in index.entries.inputFiles()}
    assert {int(f) for f in folders} <= set(range(len(index.starts))) and len(folders) > 1
    slots = {r.bucket: r for r in index.entries.groupBy("bucket").agg(F.min(F.shiftrightunsigned("hash", 48)).alias("low"), F.max(F.shiftrightunsigned("hash", 48)).alias("high"), F.count("hash").alias("n")).collect()}
    for k, start in enumerate(index.starts):
        end = (index.starts + [1 << 16])[k + 1]
        assert k not in slots or start <= slots[k].low <= slots[k].high < end and slots[k].n <= 2


def test_directory_doubles_where_it_overflows():
    assert exact_dedup.directory({0: 5, 40_000: 5}, 20) == [0]
    starts = exact_dedup.directory({0: 5, 1: 5, 40_000: 5}, 6)
    assert starts[0] == 0 and 1 in starts and 32_768 in starts
    assert len(exact_dedup.directory({s: 1 for s in range(0, 65536, 64)}, 16)) >= 64


def test_empty(none):
    assert exact_dedup.dedup_report(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.apply_mix(none).count() == 0


def words(t):
    return len((t or "").encode().split())


def water(sizes, weights, most=3):
    """Shares by weight, limits set one round after the other."""
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] >= most * sizes[s]}
        if not full:
            return target | {s: unit * weights[s] for s in open_}
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    data = [(k, " ".join(["w"] * int(rnd.integers(0, 30))) if k % 17 else None, ["a", "b", "c", "d", None][min(4, int(rnd.integers(0, 9)) // 2)]) for k in range(400)]
    data += [(1000, "x y", "tiny")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += words(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    want = water(sizes, weights)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.size <= 30 and 0 <= r.taken <= 3 * r.size and (r.size == 0) == (r.taken == 0 and r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)
    assert want["tiny"] == 6.0 and taken["tiny"] == 6
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.apply_mix(odd).columns == odd.columns


def test_rows_that_share_an_id_are_mixed_one_by_one(spark):
    rows = [(1, " ".join(["w"] * n), "a") for n in (1, 2, 3, 5, 8, 13, 21, 34)] + [(1, "w w w", "a")] * 3 + [(None, "v " * n, "b") for n in (1, 2, 3, 4, 5, 6, 9)] + [(k, "x y z", None) for k in (7, 7, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(docs).collect()
    out = mixing.apply_mix(docs).collect()
    assert sorted(words(r.text) for r in out if r.source == "a") == sorted(r.size for r in plan if r.source == "a" for _ in range(r.times))
    for s in ("a", "b", None):
        assert sum(words(r.text) for r in out if r.source == s) == sum(r.taken for r in plan if r.source == s)
        assert abs(sum(r.taken for r in plan if r.source == s) - next(r.target for r in plan if r.source == s)) <= 3


def test_knapsack_is_the_best_sum():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        sizes = np.unique(rnd.integers(1, 12, 4))
        left = rnd.integers(0, 4, len(sizes))
        budget = int(rnd.integers(0, 40))
        got = mixing.knapsack(sizes, left, budget)
        assert (got <= left).all() and (got * sizes).sum() <= budget
        sums = {0}
        for s, n in zip(sizes, left, strict=True):
            sums = {a + k * s for a in sums for k in range(n + 1)}
        assert (got * sizes).sum() == max(x for x in sums if x <= budget)
