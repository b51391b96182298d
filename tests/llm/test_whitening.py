"""Whitening against whole-number arithmetic over all vectors in one place."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, component int, width string"


def plain(rows):
    """n, S, V (fractions rounded once), the x of each whole row."""
    kept = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[n * x[j] - s[j] for j in range(d)] for x in fit]
    v = np.array([[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(d)] for i in range(d)])
    return n, s, v, kept


def check(rows, got, components=16):
    n, s, v, kept = plain(rows)
    d = len(s)
    e = np.linalg.eigvalsh(v)[::-1]
    assert Counter(r.vec_id for r in got) == Counter({i: k * min(components, d) for i, k in Counter(i for i, _ in kept).items()})
    xs = dict(kept)
    by_id = {}
    for r in got:
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(xs[r.vec_id], s, strict=True))
        assert math.isclose(r.explained, e[r.component - 1] / np.trace(v), rel_tol=1e-9) and r.identity_error <= 1e-9
        by_id.setdefault(r.vec_id, {})[r.component] = r.whitened
    # each component is one direction for all rows: the projections give it back, and it is an eigenvector
    ids = sorted({xs[i]: i for i in by_id if i is not None}.values())
    z = np.array([[by_id[i][k + 1] for k in range(min(components, d))] for i in ids])
    c = np.array([[xs[i][j] - s[j] / n for j in range(d)] for i in ids])
    u = (c.T @ z) / n / np.sqrt(e[: z.shape[1]])
    assert np.allclose(np.linalg.norm(u, axis=0), 1, atol=1e-9) and np.allclose(v @ u, u * e[: u.shape[1]], atol=1e-8 * e[0])
    assert np.allclose(c @ u / np.sqrt(e[: u.shape[1]]), z, atol=1e-9)


@pytest.mark.parametrize(("width", "tile", "rows"), [(5, 2, 7), (20, 8, 1024), (33, 32, 16)])
def test_against_plain(spark, width, tile, rows):
    rnd = np.random.default_rng(width)
    data = [(i, [float(np.float32(c)) for c in rnd.normal(size=width) * np.linspace(0.3, 2, width)]) for i in range(150)]
    data += [(200 + i, data[3][1]) for i in range(60)]
    data += [(300, None), (301, [None] + [0.5] * (width - 1)), (302, [math.nan] + [0.5] * (width - 1)), (303, [math.inf] * width), (data[5][0], data[5][1])]
    table = spark.createDataFrame([(*r, 1, 2, 3, "w") for r in data], SCHEMA).repartition(3)
    check(data, whitening.whitened(table, tile=tile, rows=rows).collect())


def test_other_lengths_nulls_and_constant_dimensions(spark):
    data = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)] + [(None, [1.0, 2.0, 1.0]), (90, []), (91, [1.0]), (92, None)]
    got = whitening.whitened(spark.createDataFrame([(*r, 1, 2, 3, "w") for r in data], SCHEMA)).collect()
    assert Counter(r.vec_id for r in got) == Counter({**dict.fromkeys(range(30), 3), None: 3, 90: 1, 91: 1})
    assert all(r.component is None and r.n is None for r in got if r.vec_id in (90, 91))
    assert all((r.whitened is None) == (r.component == 3) and r.identity_error < 1e-9 for r in got if r.vec_id not in (90, 91))


def test_a_single_vector_and_no_vector(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, 0, ""), (1, [1.0, 2.0], 0, 0, 0, "")], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    assert whitening.whitened(spark.createDataFrame([(1, None, 0, 0, 0, "")], SCHEMA)).count() == 0
    empty = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries(spark):
    data = [(i, [3e38 if i == 1 else float(i), float(i * i)], 0, 0, 0, "") for i in range(10)]
    got = whitening.whitened(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 20 and all(r.deviation is None for r in got)


def test_query_against_plain(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, whitening.op11_whitening(spark, sf).collect())
