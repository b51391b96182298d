"""Claims and runs: streaks, history, freshness, health, and the noisy-OR of weighted evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clamp01
from tidemark.schema import ORIGINS, STALE_HOURS, TIER_WEIGHT


def tier_weight(tier: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in TIER_WEIGHT.items() for x in (k, v)]), tier)


def noisy_or(tier: Column, weight: Column, place: Column | None = None) -> Column:
    """One less the product of what each claim leaves open; a sum of logarithms would lose a weight of one. With `place`, factors are multiplied in that order:
    the last bit of a product of doubles hangs on it, and with it a value that is rounded at a boundary."""
    open_ = 1 - clamp01(weight * tier_weight(tier))
    if place is None:
        return 1 - F.product(open_)
    return 1 - F.aggregate(F.array_sort(F.collect_list(F.struct(place.alias("place"), open_.alias("open")))), F.lit(1.0), lambda p, c: p * c["open"])


def streaks(rows: DataFrame, keys: list[str], latest_first: list[Column], value: str) -> DataFrame:
    """How many rows in a row, from the latest back, hold the latest value."""
    w = Window.partitionBy(*keys).orderBy(*latest_first)
    marked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.first(value).over(w))
    other = F.min(F.when(~F.col(value).eqNullSafe(F.col("_last")), F.col("_n"))) - 1
    return marked.groupBy(*keys).agg(F.coalesce(other, F.count(F.lit(1))).cast("bigint").alias("streak"))


def collapse_history(claims: DataFrame) -> DataFrame:
    """Per event and origin: days, first and last sight, and the tier of the latest row."""
    return claims.groupBy("event_id", "origin").agg(
        F.count_distinct("claim_date").alias("days"), F.min("claim_date").alias("first_seen"), F.max("claim_date").alias("last_seen"), F.max_by("tier", F.struct("run", "ref")).alias("tier")
    )


def health(runs: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "FAILED")
    total = F.count(F.lit(1))
    state = F.when(failed == 0, "OK").when(failed == total, "FAILED").otherwise("PARTIAL")
    return runs.groupBy("scan_id").agg(total.alias("runs"), failed.alias("failed"), state.alias("health"))


def freshness(runs: DataFrame, now: str) -> DataFrame:
    """Hours since a provider's last good run, or since it was first seen; stale from STALE_HOURS on. `ok` marks good runs."""
    at = F.to_timestamp_ntz(F.lit(now))
    seen = runs.groupBy("provider").agg(F.min("started_at").alias("first_seen_at"), F.max(F.when(F.col("ok"), F.col("started_at"))).alias("last_ok_at"))
    seconds = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.coalesce("last_ok_at", "first_seen_at").cast("timestamp"))
    return seen.select("provider", "first_seen_at", "last_ok_at", F.floor(seconds / F.lit(3_600_000_000)).cast("bigint").alias("hours"), (seconds >= STALE_HOURS * 3_600_000_000).alias("stale"))


def lineage_sql() -> str:
    """Each origin with all it derives from, as SQL over a table `origins(key, parent)`; a cycle ends at depth 8."""
    return """
    WITH RECURSIVE up(origin, ancestor, depth) AS (
      SELECT key, key, 0 FROM {origins} UNION ALL SELECT up.origin, o.parent, up.depth + 1 FROM up JOIN {origins} o ON o.key = up.ancestor WHERE o.parent IS NOT NULL AND up.depth < 8
    )
    SELECT DISTINCT origin, ancestor FROM up"""


def origins(spark) -> DataFrame:
    return spark.createDataFrame(ORIGINS, "key string, tier string, parent string")


def independent(spark, registry: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of origins whose lineages share nothing. The registry is a handful of rows."""
    registry = registry if registry is not None else origins(spark)
    up = spark.sql(lineage_sql(), origins=registry)
    keys = registry.select("key")
    pairs = keys.alias("a").join(keys.alias("b"), F.col("a.key") < F.col("b.key")).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))
    shared = up.alias("x").join(up.alias("y"), (F.col("x.ancestor") == F.col("y.ancestor")) & (F.col("x.origin") < F.col("y.origin"))).select(F.col("x.origin").alias("a"), F.col("y.origin").alias("b"))
    return pairs.join(shared, ["a", "b"], "left_anti")


def first_state(claims: DataFrame) -> DataFrame:
    """The state before any run: event_id, origin, claim_date, streak, missed."""
    return claims.select("event_id", "origin", "claim_date", F.lit(0).cast("bigint").alias("streak"), F.lit(0).cast("bigint").alias("missed")).limit(0)


def advanced(state: DataFrame, claims: DataFrame) -> DataFrame:
    """The state after one more run, from its claims (event_id, origin, claim_date) alone. A claim that says the same again adds to its streak, another date starts anew, and an origin
    that is silent keeps its streak and misses a run; one that speaks again has missed none."""
    said = claims.groupBy("event_id", "origin").agg(F.max("claim_date").alias("_day"), F.lit(True).alias("_said"))
    both = state.join(said, ["event_id", "origin"], "full")
    again = F.col("claim_date").eqNullSafe(F.col("_day"))
    return both.select(
        "event_id",
        "origin",
        F.when(F.col("_said"), F.col("_day")).otherwise(F.col("claim_date")).alias("claim_date"),
        F.when(F.col("_said"), F.when(again & F.col("streak").isNotNull(), F.col("streak") + 1).otherwise(1)).otherwise(F.col("streak")).cast("bigint").alias("streak"),
        F.when(F.col("_said"), 0).otherwise(F.col("missed") + 1).cast("bigint").alias("missed"),
    )
