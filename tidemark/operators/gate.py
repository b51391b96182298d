"""The gate: from an event's claims and what is published, decide by fixed rules what to publish, hold, flag or let go stale.

All events are decided in one plan: claims are gathered per event once, in a fixed order, and the rules are functions on
that array. So one shuffle serves every rule, and the order of the input changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import (
    ABSENCE_DAYS,
    AGREEMENT_DAYS,
    ANNOUNCED_AT,
    CONFIRMED_AT,
    CONTRADICTION_FACTOR,
    LARGE_SHIFT_DAYS,
    ORIGINS,
    RETAILER_RUNS,
    RULE_PRIORITY,
    TIER_RANK,
    TIER_WEIGHT,
)


def lineages(origins: list[tuple]) -> dict[str, list[str]]:
    """Each origin with all it derives from; a cycle ends where it closes."""
    parent = {o[0]: o[2] for o in origins}
    out = {}
    for key in parent:
        seen, at = [], key
        while at and at not in seen:
            seen.append(at)
            at = parent.get(at)
        out[key] = seen
    return out


def _sql_map(values: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def evaluate(claims: DataFrame, published: DataFrame, now: str, origins: list[tuple] = ORIGINS, agreement: int = AGREEMENT_DAYS, shift: int = LARGE_SHIFT_DAYS) -> DataFrame:
    """Verdicts: event_id, action, rule, reason, day, kind, status, confidence, gap, supporting (origins), contradicted (origins).

    claims: event_id, origin, tier, kind, day, live, runs, weight, last_seen, seq (which orders claims of one origin), and maybe
    place: the order in which weights are multiplied, else by origin and seq; the last bit of a product of doubles hangs on it.
    published: event_id, pub_kind, pub_day, pub_end, pub_status, expected (array of days, or null); one row per event with claims or without.
    """
    lineage = _sql_map({k: "array(" + ", ".join(f"'{x}'" for x in v) + ")" for k, v in lineages(origins).items()})
    rank, weight = _sql_map({k: str(v) for k, v in TIER_RANK.items()}), _sql_map({k: f"{v}D" for k, v in TIER_WEIGHT.items()})
    placed = "place" in claims.columns
    near = lambda a, b: f"abs(datediff({a}, {b})) <= {agreement}"
    entry = F.struct("origin", "seq", "tier", "kind", "day", "live", "runs", "weight", "last_seen", F.expr(f"{rank}[tier]").alias("rank"), F.expr(f"{lineage}[origin]").alias("lineage"), F.expr(f"greatest(0D, least(1D, weight * {weight}[tier]))").alias("w"), *([F.expr("if(true, place, null)").alias("place")] if placed else []))
    gathered = claims.groupBy("event_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    rows = published.join(gathered, "event_id", "left").withColumn("all", F.coalesce("all", F.expr(f"filter(array(named_struct('origin', '', 'seq', 0L, 'tier', '', 'kind', '', 'day', date'2000-01-01', 'live', false, 'runs', 0, 'weight', 0D, 'last_seen', date'2000-01-01', 'rank', 0, 'lineage', array(''), 'w', 0D{", 'place', null" if placed else ""})), x -> false)").cast(gathered.schema["all"].dataType)))
    step = lambda df, **c: df.withColumns({k: F.expr(v) for k, v in c.items()})
    rows = step(rows, dated="filter(all, c -> c.live and c.day is not null)", n_live="size(filter(all, c -> c.live))")
    rows = step(rows, eligible="filter(dated, c -> c.tier <> 'SPECULATIVE')")
    rows = _with_flag(rows, near)
    prio = RULE_PRIORITY
    lone = lambda rule, cond: f"""transform(filter(eligible, c -> {cond}), c -> named_struct('prio', {prio[rule]}, 'rank', c.rank, 'runs', -c.runs, 'key', c.origin, 'i', c.seq, 'j', 0L,
        'rule', '{rule}', 'day', c.day, 'kind', c.kind, 'low', c.day, 'high', c.day, 'origins', array(c.origin)))"""  # noqa: E731
    pairs = f"""flatten(transform(eligible, (a, n) -> transform(filter(slice(eligible, n + 2, greatest(size(eligible) - n - 1, 0)), b -> not arrays_overlap(a.lineage, b.lineage) and {near("a.day", "b.day")}),
        b -> named_struct('prio', {prio["G2"]}, 'rank', least(a.rank, b.rank), 'runs', -greatest(a.runs, b.runs), 'key', concat_ws('|', least(a.origin, b.origin), greatest(a.origin, b.origin)), 'i', a.seq, 'j', b.seq,
        'rule', 'G2', 'day', if(a.rank <= b.rank, a.day, b.day), 'kind', if(a.rank <= b.rank, a.kind, b.kind), 'low', least(a.day, b.day), 'high', greatest(a.day, b.day), 'origins', array_distinct(array(a.origin, b.origin))))))"""
    rows = step(
        rows,
        proposals=f"concat({lone('G1', 'c.tier = \'OFFICIAL\'')}, {pairs}, {lone('G3', f'c.tier = \'RETAILER\' and not c.bad and c.runs >= {RETAILER_RUNS}')}, {lone('G8', f'not c.bad and exists(coalesce(expected, array()), x -> {near("x", "c.day")})')})",
    )
    rows = step(rows, best="array_min(proposals)", widest="datediff(array_max(transform(proposals, p -> p.high)), array_min(transform(proposals, p -> p.low)))")
    rows = step(
        rows,
        moved="if(best.kind = 'EXACT' and pub_kind in ('WINDOW', 'RANGE') and best.day between pub_day and pub_end, null, abs(datediff(pub_day, best.day)))",
        absent=f"coalesce(datediff(date'{now}', array_max(transform(all, c -> c.last_seen))), 0)",
    )
    rows = step(
        rows,
        action=f"case when n_live = 0 then 'STALE' when size(proposals) = 0 then 'HOLD' when widest > {agreement} or moved > {shift} then 'FLAG' else 'PUBLISH' end",
        rule=f"case when n_live = 0 then 'G7' when size(dated) = 0 then 'NONE' when size(eligible) = 0 then 'G4' when size(proposals) = 0 then 'NONE' when widest > {agreement} then 'G5' when moved > {shift} then 'G6' else best.rule end",
    )
    rows = step(rows, settled="if(action = 'PUBLISH', best.day, pub_day)")
    rows = step(rows, for_it=f"filter(all, c -> settled is null or c.day is null or {near('c.day', 'settled')})")
    factors = "array_sort(transform(for_it, c -> named_struct('place', c.place, 'w', c.w)))" if placed else "for_it"
    rows = step(rows, confidence=f"greatest(0D, least(1D, (1D - aggregate({factors}, 1D, (acc, c) -> acc * (1D - c.w))) * power({CONTRADICTION_FACTOR}D, size(all) - size(for_it))))")
    scored = f"case when exists(for_it, c -> c.tier = 'OFFICIAL') or confidence >= {CONFIRMED_AT} then 'CONFIRMED' when confidence >= {ANNOUNCED_AT} then 'ANNOUNCED' else 'RUMORED' end"
    rows = step(rows, scored=scored)
    rows = step(
        rows,
        cancels=f"n_live = 0 and size(all) > 0 and absent >= {ABSENCE_DAYS} and (pub_day is null or pub_day > date'{now}') and coalesce(pub_status, scored) <> 'CANCELLED'",
        past=f"best.kind in ('EXACT', 'RANGE') and date_add(best.day, 1) <= date'{now}'",
    )
    reason = """case when action = 'STALE' then if(cancels, 'ABSENT_CANCELLED', 'ABSENT') when size(dated) = 0 then 'NO_DATED_CLAIMS' when rule = 'G4' then 'SPECULATIVE_ONLY'
        when action = 'HOLD' then if(exists(eligible, c -> c.bad), 'CONTRADICTED', 'AWAITING_CORROBORATION') when rule = 'G5' then 'CONFLICT' when rule = 'G6' then 'LARGE_SHIFT'
        when rule = 'G1' then 'OFFICIAL_SINGLE' when rule = 'G2' then 'INDEPENDENT_AGREEMENT' when rule = 'G3' then 'RETAILER_STREAK' else 'SCHEDULE_CORROBORATED' end"""
    status = """case when action = 'STALE' then if(cancels, 'CANCELLED', coalesce(pub_status, scored)) when action = 'PUBLISH' then if(pub_status = 'RELEASED' and past, 'RELEASED', scored)
        else coalesce(pub_status, 'RUMORED') end"""
    return rows.select(
        "event_id", "action", "rule", F.expr(reason).alias("reason"), F.expr("settled").alias("day"), F.expr("if(action = 'PUBLISH', best.kind, pub_kind)").alias("kind"), F.expr(status).alias("status"), "confidence",
        F.expr("case rule when 'G5' then widest when 'G6' then moved end").alias("gap"),
        F.expr("case when action = 'PUBLISH' then best.origins when rule = 'G4' then array_distinct(transform(dated, c -> c.origin)) else array() end").alias("supporting"),
        F.expr("array_distinct(transform(filter(eligible, c -> c.bad), c -> c.origin))").alias("contradicted"),
    )


def _with_flag(rows: DataFrame, near) -> DataFrame:
    """eligible with `bad`: whether another origin states a day further off than the agreement."""
    fields = ["origin", "seq", "tier", "kind", "day", "runs", "rank", "lineage"]
    named = ", ".join(f"'{f}', c.{f}" for f in fields)
    return rows.withColumn("eligible", F.expr(f"transform(eligible, c -> named_struct({named}, 'bad', exists(eligible, o -> o.origin <> c.origin and not {near('o.day', 'c.day')})))"))


def diff(verdicts: DataFrame, published: DataFrame) -> DataFrame:
    """What a run changed: one row per event whose day or status the verdict moves, with the kind of notice it makes."""
    rows = verdicts.join(published, "event_id")
    notice = F.when(F.col("pub_status").isNull(), "created").when((F.col("status") == "RELEASED") & (F.col("pub_status") != "RELEASED"), "released").when(F.col("status") != F.col("pub_status"), "status_changed")
    moved = ~F.col("day").eqNullSafe(F.col("pub_day")) | ~F.col("status").eqNullSafe(F.col("pub_status"))
    return rows.where(moved).select("event_id", "action", "rule", "reason", F.col("pub_day").alias("day_before"), F.col("day").alias("day_after"), F.col("pub_status").alias("status_before"), F.col("status").alias("status_after"), notice.alias("notice"))
