"""Embedding whitening from a tiled covariance.

Entries become whole numbers in steps of 1 / SCALE. The fit list, each distinct vector once, is a table in the shared folder. Its covariance is
computed by tiles: the pairs of dimensions are parted into tiles of TILE by TILE; each block of rows is centred and cut into column blocks; column
blocks meet by their row block in a shuffle, pairs of them are multiplied, products are summed per tile, and the tiles are assembled and decomposed.

Vectors are centred before they are multiplied, by the whole part of the mean; the fraction that is left, below one, comes off the assembled sums in whole
numbers. Sums of products are whole numbers too, exact while below 2 ** 53, so that the covariance is rounded once, and a task that runs again adds the same.

Defined cases: rows whose vector is null, or holds a null, NaN or infinite entry, are dropped. Vectors must be of one length to have a covariance: rows of another length than the
most frequent one (ties: the longest) stay as one row each, with null numbers. Entries beyond 2 ** 52 / SCALE count as that. A component whose
eigenvalue is rounding noise (constant or dependent dimensions, a single vector) has null `whitened`; `identity_error` is over the others, null if there are none. A deviation beyond a
long is null. A null id stays; rows that repeat are repeated; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Dimensions of a column block, and rows of a row block at most.
TILE = 32
ROWS = 256
#: Tiles that a task sums up before it sends them on.
HELD = 64


@dataclass(frozen=True)
class Whitening:
    """n and sums: size of the fit list and its sums by dimension; base and rest: sums div n and mod n; values: all eigenvalues, falling; vectors: one column per component;
    scales: one over the square root of each component's eigenvalue, 0 where that is noise; error: of the covariance of what it whitens from the identity."""

    n: int
    sums: list[int]
    base: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    scales: np.ndarray
    error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([r / self.n for r in self.rest])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of x, centred, on the components, over the square roots of their eigenvalues."""
        return ((x - self.base) - self.mean) @ (self.vectors * self.scales)


def quantised(vectors: DataFrame, column: str) -> DataFrame:
    """The rows with whole vectors, and x in place of the column."""

    def whole(c: Column) -> Column:
        most = float(2**52)
        return F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * SCALE))).cast("long") + SHIFT

    c = F.col(column)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    return vectors.where(c.isNotNull() & finite).withColumn("x", F.transform(c, whole)).drop(column)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def tile_sums(fit: DataFrame, centred: Callable[[np.ndarray], np.ndarray], width: int, out: int, tile: int = TILE, rows: int = ROWS) -> np.ndarray:
    """The sums over the table's vectors x of `centred(x)`'s products, an `out` by `out` matrix. The table must be one on files: blocks of rows are told apart by their place in it, which is
    the same when a task runs again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                y = centred(_matrix(batch.column("x").slice(at, rows), width))
                narrow = next((t for t in (np.int16, np.int32) if np.array_equal(y.astype(t), y)), np.float64)
                blocks = [(i, y[:, i * tile : (i + 1) * tile].astype(narrow)) for i in range(-(-out // tile))]
                yield pa.RecordBatch.from_pydict({"row_block": pa.array([part << 40 | k] * len(blocks), pa.int64()), "i": pa.array([i for i, _ in blocks], pa.int32()), "kind": [np.dtype(narrow).str] * len(blocks), "data": pa.array([np.ascontiguousarray(b).tobytes() for _, b in blocks], pa.binary())})
                k += 1

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_pydict({"i": pa.array([i for i, _ in keys], pa.int32()), "j": pa.array([j for _, j in keys], pa.int32()), "products": pa.array([held[k].ravel() for k in keys], pa.list_(pa.float64()))})

        for batch in batches:
            for i, j, kind, left, right in zip(*(batch.column(c) for c in ("i", "j", "kind", "left", "right")), strict=True):
                i, j = i.as_py(), j.as_py()
                a, b = (np.frombuffer(d.as_buffer(), kind.as_py()).reshape(-1, min(tile, out - k * tile)).astype(np.float64) for d, k in ((left, i), (right, j)))
                held[i, j] = held.get((i, j), 0) + a.T @ b
                if len(held) > HELD:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    blocks = fit.select("x").mapInArrow(cut, "row_block long, i int, kind string, data binary")
    left = blocks.withColumnRenamed("data", "left")
    right = blocks.select("row_block", F.col("i").alias("j"), F.col("data").alias("right"))
    tiles = left.hint("merge").join(right.hint("merge"), "row_block").where("i <= j").select("i", "j", "kind", "left", "right").mapInArrow(multiplied, "i int, j int, products array<double>")
    cells = tiles.select("i", "j", F.posexplode("products").alias("cell", "v")).groupBy("i", "j", "cell").agg(F.sum("v").alias("v"))
    got = np.zeros((out, out))
    for r in cells.collect():  # as many as there are pairs of dimensions
        wide = min(tile, out - r.j * tile)
        a, b = r.i * tile + r.cell // wide, r.j * tile + r.cell % wide
        got[a, b] = got[b, a] = r.v
    return got


def fit_whitening(x: DataFrame, width: int, components: int = COMPONENTS, tile: int = TILE, rows: int = ROWS) -> Whitening | None:
    """From a table with vectors x of one length. None if it has no rows or no dimensions."""
    fit = materialise(x.select("x").distinct())
    sums = {r.d: int(r.s) for r in fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()}
    n = fit.count()
    if not n or not width:
        return None
    total = [sums[d] for d in range(width)]
    base, rest = np.array([s // n for s in total], np.int64), [s % n for s in total]
    whole = tile_sums(fit, lambda v: (v - base).astype(np.float64), width, width, tile, rows)
    covariance = np.array([[float((n * Fraction(whole[i, j]) - rest[i] * rest[j]) / n**2) for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    top = values[: vectors.shape[1]]
    real = top > max(values[0], 0) * width * np.finfo(float).eps * 4
    scales = np.where(real, 1 / np.sqrt(np.where(real, top, 1)), 0.0)
    made = Whitening(n, total, base, rest, values, vectors, scales, None)
    if not real.any():
        return made
    again = tile_sums(fit, made.whiten, width, vectors.shape[1], tile, rows) / n - np.diag(real.astype(float))
    return Whitening(n, total, base, rest, values, vectors, scales, float(np.abs(again).max()))


def whitened(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each whole vector and component. One pass over the table after the fit."""
    x = quantised(vectors.select("vec_id", column), column)
    lengths = x.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = lengths[0].width if lengths else 0
    made = fit_whitening(x.where(F.size("x") == width), width, components, tile, rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = x.select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    other = x.where(F.size("x") != width) if made else x
    alone = other.selectExpr("vec_id", "cast(null as int) as component", "cast(null as bigint) as n", "cast(null as bigint) as deviation", *[f"cast(null as double) as {c}" for c in ("whitened", "explained", "identity_error")])
    if made is None:
        return alone
    spread = float(made.values.sum())
    shares = [float(v) / spread if spread > 0 else None for v in made.values[: len(made.scales)]]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, rest, squares = len(made.scales), np.array(made.rest, np.float64), sum(r * r for r in made.rest)
        exact = np.array(made.rest, object)
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch.column("x"), width)
            y = x - made.base
            small = max(1.0, float(np.abs(y).max(initial=0))) * max(1.0, float(rest.max(initial=0)), float(np.abs(y).max(initial=0))) * width < 2**62
            ys, rs = (y, np.array(made.rest, np.int64)) if small else (y.astype(object), exact)
            own, cross = (ys * ys).sum(axis=1).tolist(), (ys @ rs).tolist()
            deviation = [made.n**2 * int(a) - 2 * made.n * int(b) + squares for a, b in zip(own, cross, strict=True)]
            found = made.whiten(x)
            found = pa.array(found.ravel(), mask=np.tile(made.scales == 0, m)) if m else pa.array([], pa.float64())
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k), pa.int64())),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, made.n, np.int64)),
                "deviation": pa.array([d if d < 2**63 else None for d in deviation for _ in range(k)], pa.int64()),
                "whitened": found,
                "explained": pa.array(shares * m, pa.float64()),
                "identity_error": pa.array([made.error] * (m * k), pa.float64()),
            })

    return x.where(F.size("x") == width).mapInArrow(rows_of, schema).unionByName(alone)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
