"""Mixing sources to target weights by fitting a word budget exactly.

A document's size is its number of words. Each source has a weight and a target; a target stops at MAX_PASSES times
the source's size and the excess goes to the others by weight. A source's target is then its whole size some whole
number of times, and a rest. For the rest, documents are counted by exact size; each size first gets its proportional
share, then a bounded-knapsack dynamic programme over the counts fills what remains, and the documents of each size
are taken in a seeded order until its count is met.

Defined cases: a null text or one without words has size 0 and takes 0; a null source is a source of its own, last in
order; an empty table gives an empty result; rows that repeat a doc_id count one by one; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_GAP, documents, fresh, materialise

MAX_PASSES = 3
WEIGHTS = (1, 2, 3)
SEED = 20
#: Parts of the seeded order; a part of one source and size is ranked in one task.
ORDER_PARTS = 4096


def _measured(docs: DataFrame, seed: int, names: list[str]) -> DataFrame:
    """docs with further columns: size, a hash of the text, part of the seeded order, and the source as two columns without nulls."""
    size, th, part, missing, own = names
    words = F.filter(F.split(F.coalesce("text", F.lit("")), WORD_GAP), lambda w: w != "")
    rows = docs.withColumns({size: F.size(words).cast("long"), th: F.xxhash64("text"), missing: F.col("source").isNull(), own: F.coalesce("source", F.lit(""))})
    return rows.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), "doc_id", th), F.lit(ORDER_PARTS)).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, source_size, target. Sources are few: they are ordered in one window.

    With the sources in ascending order of (limit / weight), the limited ones come first. A source is limited if the words
    that are left after those before it, shared by weight among it and those after it, exceed its limit.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per_source.withColumn("_n", F.row_number().over(place) - 1).withColumn("_w", F.element_at(kinds, (F.col("_n") % len(weights)).cast("int") + 1))
    limit = (F.col("source_size") * max_passes).cast("double")
    before = Window.orderBy(F.col("_limit") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("_limit") / F.col("_w"), "_n").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.col("_limit") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        weighed.withColumn("_limit", limit)
        .withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_limited", F.col("_level") * F.col("_w") >= F.col("_limit"))
        .withColumn("_open", F.max(F.when(~F.col("_limited"), F.col("_level"))).over(everything))
    )
    return shared.select("source", "source_size", F.when(F.col("_limited"), F.col("_limit")).otherwise(F.col("_open") * F.col("_w")).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, so that their words come as near to the budget as this finds without
    passing it: proportional shares, then a dynamic programme over the rest."""
    taken = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.astype(np.int64)
    taken = counts * budget // total
    rest = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):  # the largest documents that fit, one of each size
        if 2 * int(sizes.max()) < rest and 0 < sizes[i] <= rest and taken[i] < counts[i]:
            taken[i] += 1
            rest -= int(sizes[i])
    return taken + knapsack(sizes, counts - taken, rest)


def knapsack(sizes: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the largest sum up to the budget. reach[s] is the first size, in order, at which the sum s
    came into reach, used[s] how many documents of that size the sum then takes."""
    got = np.zeros(len(sizes), np.int64)
    if budget <= 0:
        return got
    reach = np.full(budget + 1, -1, np.int64)
    used = np.zeros(budget + 1, np.int64)
    reach[0] = len(sizes)
    for i in np.flatnonzero((sizes > 0) & (sizes <= budget) & (left > 0)):
        size, new = int(sizes[i]), []
        front = np.flatnonzero(reach >= 0)
        for k in range(1, min(int(left[i]), budget // size) + 1):
            front = front[front + size <= budget] + size
            fresh = front[reach[front] < 0]
            if not len(front):
                break
            new.append((fresh, k))
            front = fresh
            reach[fresh], used[fresh] = i, k
        if reach[budget] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0).max())
    while at:
        i, k = int(reach[at]), int(used[at])
        got[i] += k
        at -= k * int(sizes[i])
    return got


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    total, target = int((sizes * counts).sum()), float(rows["target"].iloc[0])
    passes = int(target // total) if total else 0
    rows["passes"] = passes
    rows["more"] = fit(sizes, counts, int(round(target - passes * total)))
    return rows[["source", "size", "passes", "more"]]


NAMES = ["size", "th", "part", "missing", "own"]


def _shares(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """missing, own, size, part, passes, quota: how often the mix takes all rows of a source, size and part, and how many of them once more."""
    counts = materialise(sizes.groupBy("missing", "own", "size", "part").agg(F.count(F.lit(1)).alias("n")))
    by_size = counts.groupBy("missing", "own", "size").agg(F.sum("n").alias("n")).withColumn("source", F.when(~F.col("missing"), F.col("own")))
    plan = (
        by_size.join(goals, by_size["source"].eqNullSafe(goals["source"]))
        .select(by_size["source"], "size", "n", "target")
        .groupBy("source")
        .applyInPandas(_fit_source, "source string, size long, passes int, more long")
    )
    plan = materialise(plan.select(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("own"), "size", "passes", "more"))
    # Each part's share of the count of its size: parts in order, until the count is met.
    earlier = Window.partitionBy("missing", "own", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(plan, ["missing", "own", "size"])
    return shares.select("missing", "own", "size", "part", "passes", F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.col("_before"))).alias("quota"))


def _timed(rows: DataFrame, shares: DataFrame, seed: int, names: list[str], times: str) -> DataFrame:
    """rows with how often each is taken, by its place in the seeded order of its part. One shuffle serves the order and the join."""
    size, th, part, missing, own = names
    keys = {"missing": missing, "own": own, "size": size, "part": part}
    passes, quota, rank = (fresh(rows, x) for x in ("passes", "quota", "rank"))
    order = Window.partitionBy(*keys.values()).orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", th), "doc_id", th)
    plan = shares.select(*[F.col(k).alias(v) for k, v in keys.items()], F.col("passes").alias(passes), F.col("quota").alias(quota))
    met = rows.withColumn(rank, F.row_number().over(order)).join(plan.hint("merge"), list(keys.values()))
    return met.withColumn(times, F.col(passes) + (F.col(rank) <= F.col(quota)).cast("int")).drop(passes, quota, rank)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, times (how often the mix takes it), taken."""
    sizes = materialise(_measured(docs.select("doc_id", "source", "text"), seed, NAMES).drop("text"))
    goals = materialise(targets(sizes, weights, max_passes))
    taken = _timed(sizes, _shares(sizes, goals), seed, NAMES, "times")
    goals = F.broadcast(goals) if goals.count() <= 100_000 else goals
    return (
        taken.alias("t")
        .join(goals.alias("g"), F.expr("t.source <=> g.source"))
        .select("doc_id", "t.source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))
    )


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all its columns; rows that share a doc_id are taken one by one."""
    sizes = materialise(_measured(docs.select("doc_id", "source", "text"), seed, NAMES).drop("text"))
    shares = _shares(sizes, materialise(targets(sizes, weights, max_passes)))
    names = [fresh(docs, x) for x in NAMES]
    n, copy = fresh(docs, "times"), fresh(docs, "copy")
    chosen = _timed(_measured(docs, seed, names), shares, seed, names, n).where(F.col(n) > 0)
    return chosen.withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")
