"""Histories that depend on order: rate limits whose rejected hits don't count, changes from one payload to the next, notices of alarms, bounded crawls, unique slugs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.snapshots import settled
from tidemark.schema import REPEAT_HOURS, STALE_HOURS


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def rate_limited(hits: DataFrame, key: str, at: str, ident: str, limit: int, seconds: int) -> DataFrame:
    """key, ident, allowed: a hit is allowed if fewer than `limit` allowed ones of its key lie less than `seconds` back; ties in order of ident.

    A pause of `seconds` forgets all, so a key's hits fall into spells that don't touch: found from the first and last hit of each slot of that length, which
    combine before they move. Spells are dealt to tasks one by one; a task streams a spell in order and holds the last `limit` allowed hits.
    """
    window = seconds * 1_000_000
    rows = hits.select(F.col(key).alias("key"), F.col(ident).alias("ident"), _micros(F.col(at)).alias("at")).withColumn("slot", F.expr(f"at div {window}"))
    slots = rows.groupBy("key", "slot").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    by_slot = Window.partitionBy("key").orderBy("slot")
    pause = F.coalesce(F.col("low") - F.lag("high").over(by_slot) >= window, F.lit(True))
    spells = slots.withColumn("pause", pause).withColumn("spell", F.sum(F.col("pause").cast("long")).over(by_slot)).select(F.col("key").alias("_key"), F.col("slot").alias("_slot"), "spell")
    ordered = rows.join(spells, F.col("key").eqNullSafe(F.col("_key")) & (F.col("slot") == F.col("_slot"))).select("key", "spell", "at", "ident").repartition("key", "spell").sortWithinPartitions("key", "spell", "at", "ident")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for batch in batches:
            allowed = []
            for k, spell, t in zip(*(batch.column(c).to_pylist() for c in ("key", "spell", "at")), strict=True):
                if (k, spell) != now:
                    now, kept = (k, spell), []
                kept = [x for x in kept if t - x < window]
                allowed.append(len(kept) < limit)
                if allowed[-1]:
                    kept.append(t)
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "ident": batch.column("ident"), "allowed": pa.array(allowed, pa.bool_())})

    types = dict(rows.dtypes)
    return ordered.mapInArrow(fold, f"key {types['key']}, ident {types['ident']}, allowed boolean").withColumnsRenamed({"key": key, "ident": ident})


def alarm_history(runs: DataFrame, now: str) -> DataFrame:
    """provider, at, notice (stale, still stale, recovered), opened_at from runs (provider, at, ok): every notice up to `now`.

    What counts is a provider's first run and its good ones. STALE_HOURS after one without another the alarm opens, it repeats every REPEAT_HOURS, and the next good run closes it. The
    gaps are expanded into their notices, so failed runs don't move at all.
    """
    good = runs.groupBy("provider").agg(F.min("at").alias("at")).unionByName(runs.where("ok").select("provider", "at")).distinct()
    gaps = good.withColumn("next", F.lead("at").over(Window.partitionBy("provider").orderBy("at"))).withColumn("opened_at", F.col("at") + F.expr(f"interval {STALE_HOURS} hours"))
    until = F.coalesce("next", F.lit(now).cast(dict(runs.dtypes)["at"]))
    stale = gaps.withColumn("until", until).where("opened_at <= until")
    told = stale.select("provider", "opened_at", F.explode(F.sequence("opened_at", "until", F.expr(f"interval {REPEAT_HOURS} hours"))).alias("at"))
    said = told.select("provider", "at", F.when(F.col("at") == F.col("opened_at"), "stale").otherwise("still stale").alias("notice"), "opened_at")
    return said.unionByName(stale.where("next is not null").select("provider", F.col("next").alias("at"), F.lit("recovered").alias("notice"), "opened_at"))


def crawl(links: DataFrame, seeds: DataFrame, known: DataFrame, cap: int, depth: int) -> DataFrame:
    """site, page, depth, parent, place, fetched: what a breadth-first crawl of each site visits, at most `cap` pages and `depth` links away, in the order of discovery.

    links: page, position, target; seeds: site, page, position; known: page, those that can be fetched. A page that can't be counts as visited and leads nowhere. A round takes the
    links of the frontier, drops what the site has visited, and keeps the first discovery of each page; a site's frontier is at most `cap` pages.
    """

    def placed(found: DataFrame) -> DataFrame:
        first = found.groupBy("site", "page").agg(F.min(F.struct("rank", "position", "parent")).alias("f"))
        order = Window.partitionBy("site").orderBy("f.rank", "f.position", "page")
        return first.join(known.withColumn("fetched", F.lit(True)), "page", "left").select("site", "page", F.col("f.parent").alias("parent"), F.row_number().over(order).alias("n"), F.coalesce("fetched", F.lit(False)).alias("fetched"))

    none = F.lit(None).cast(dict(links.dtypes)["page"])
    start = placed(seeds.select("site", "page", F.lit(0).alias("rank"), "position", none.alias("parent")))
    visited = settled(start.where(F.col("n") <= cap).select("site", "page", F.lit(0).alias("depth"), "parent", F.col("n").alias("place"), "fetched"))
    for step in range(1, depth + 1):
        frontier = visited.where((F.col("depth") == step - 1) & F.col("fetched")).select("site", F.col("page").alias("from"), F.col("place").alias("rank"))
        if frontier.isEmpty():
            break
        found = links.join(frontier, links["page"] == frontier["from"]).select("site", F.col("target").alias("page"), "rank", "position", F.col("from").alias("parent")).join(visited.select("site", "page"), ["site", "page"], "left_anti")
        so_far = visited.groupBy("site").agg(F.count(F.lit(1)).cast("int").alias("seen"))
        further = placed(found).join(so_far, "site").withColumn("place", F.col("seen") + F.col("n")).where(F.col("place") <= cap)
        visited = settled(visited.unionByName(further.select("site", "page", F.lit(step).alias("depth"), "parent", "place", "fetched")))
    return visited


def unique_slugs(sets: DataFrame, stored: DataFrame) -> DataFrame:
    """install_id, set_id, slug: as if sets (install_id, set_id, base, code) came in order of set_id and each took the first free one of base, base-code, and base with a hash of its id; stored: install_id, slug
    that are taken already.

    Rounds of proposals: a set proposes its first choice, a slug goes to the lowest set_id that wants it, and who loses proposes the next. As all slugs prefer the same order, that ends where
    one after the other would.
    """
    stem = F.coalesce(F.nullif("base", F.lit("")), F.lit("set"))
    coded = F.when(F.coalesce("code", F.lit("")) != "", F.concat_ws("-", F.nullif("base", F.lit("")), "code"))
    spare = F.concat_ws("-", stem, F.substring(F.sha2(F.concat_ws("|", "install_id", "set_id"), 256), 1, 6))
    choices = F.filter(F.array(F.nullif("base", F.lit("")), coded, spare, F.concat_ws("-", spare, F.col("set_id").cast("string"))), lambda c: c.isNotNull())
    taken = stored.select("install_id", "slug").distinct()
    state = settled(sets.select("install_id", "set_id", choices.alias("choices"), F.lit(1).alias("k")))
    while True:
        wanted = state.withColumn("slug", F.element_at("choices", F.col("k")))
        winners = wanted.groupBy("install_id", "slug").agg(F.min("set_id").alias("winner")).join(taken, ["install_id", "slug"], "left_anti")
        held = wanted.join(winners, ["install_id", "slug"], "left").withColumn("won", F.coalesce(F.col("winner") == F.col("set_id"), F.lit(False)))
        last = F.element_at("choices", -1)
        more = F.when(F.col("won") | (F.col("k") < F.size("choices")), F.col("choices")).otherwise(F.array_append("choices", F.concat_ws("-", last, F.col("set_id").cast("string"))))
        state = settled(held.select("install_id", "set_id", more.alias("choices"), F.when(F.col("won"), F.col("k")).otherwise(F.col("k") + 1).alias("k"), "won", "slug"))
        if state.where("not won").isEmpty():
            return state.select("install_id", "set_id", "slug")
