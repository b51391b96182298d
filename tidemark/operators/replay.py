"""A run replayed from its stored payloads: parsed, resolved, pinned, claimed, and noted. Replaying a run again changes nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normal_code
from tidemark.operators import identity
from tidemark.operators.snapshots import settled, upsert


@dataclass(frozen=True)
class Stores:
    """sets: set_id, game, name, code, synthetic, created; identities: origin, external_id, set_id; claims: run, origin, set_id, type, region, day; runs: run, game, candidates, sets, paired, payloads (a hash of theirs)."""

    sets: DataFrame
    identities: DataFrame
    claims: DataFrame
    runs: DataFrame


def _made(resolved: DataFrame, stores: Stores) -> DataFrame:
    """The sets that the run made, in the order of their makers. A code is kept if it is no ambiguous one and nobody has it."""
    new = resolved.where("matched_by = 'new'")
    many = identity.ambiguous_codes(resolved).select("game", F.col("key").alias("_own"), F.lit(True).alias("_many")).distinct()
    taken = stores.sets.select("game", "code", F.lit(True).alias("_taken")).distinct()
    known = new.withColumn("_own", normal_code("code")).join(many, ["game", "_own"], "left").join(taken, ["game", "code"], "left")
    first = F.row_number().over(Window.partitionBy("game", "code").orderBy("candidate_id")) == 1
    real = F.col("_own").isNotNull() & F.col("_many").isNull() & F.col("_taken").isNull() & first
    before = stores.sets.groupBy("game").agg(F.max("created").alias("_before"))
    created = F.coalesce("_before", F.lit(0)) + F.row_number().over(Window.partitionBy("game").orderBy("candidate_id"))
    return known.withColumn("_real", real).join(before, "game", "left").select("set_id", "game", "name", F.when(F.col("_real"), F.col("code")).alias("code"), (~F.col("_real")).alias("synthetic"), created.cast("bigint").alias("created"))


def replay(payloads: DataFrame, run: str, parse: Callable[[DataFrame], DataFrame], stores: Stores) -> Stores:
    """The stores after the payloads (sha256, and what `parse` needs) of a run. parse gives candidates: candidate_id, game, origin, name, code, external_ids, type, region, day.

    New sets and pins are added once, claims and the run's note are replaced by their keys. Every candidate pins its ids, so the next time it is found by id, at the same set: a run that is repeated, or retried
    with some payloads more, adds only what is new.
    """
    candidates = settled(parse(payloads))
    resolved = settled(identity.resolve_in_order(candidates, stores.sets, stores.identities))
    sets = settled(stores.sets.unionByName(_made(resolved, stores)))
    pins = resolved.select("candidate_id", "set_id", F.explode("external_ids").alias("origin", "external_id"))
    identities = settled(_pinned(stores.identities, pins))
    keys = ["run", "origin", "set_id", "type", "region"]
    said = resolved.groupBy("origin", "set_id", "type", "region").agg(F.max_by("day", "candidate_id").alias("day")).withColumn("run", F.lit(run))
    claims = settled(upsert(stores.claims, said.select(*stores.claims.columns), keys))
    seen = payloads.select("sha256").distinct().agg(F.coalesce(F.bit_xor(F.xxhash64("sha256")), F.lit(0)).alias("payloads")).first().payloads
    note = identity.outcomes(resolved).withColumns({"run": F.lit(run), "payloads": F.lit(seen)})
    runs = settled(upsert(stores.runs, note.select(*stores.runs.columns), ["run", "game"]))
    return Stores(sets, identities, claims, runs)


def _pinned(old: DataFrame, pins: DataFrame) -> DataFrame:
    """Ids that nobody has pinned go to the set of their first candidate."""
    first = pins.groupBy("origin", "external_id").agg(F.min_by("set_id", "candidate_id").alias("set_id"))
    return old.unionByName(first.join(old.select("origin", "external_id"), ["origin", "external_id"], "left_anti").select(*old.columns))
