import random
from datetime import datetime, timedelta

from tidemark.operators import limits
from tidemark.streaming import jobs

T0 = datetime(2024, 1, 1)


def run(spark, tmp_path, batches, schema, build, mode="append"):
    """Feed frames one after the other as files; collect what comes out."""
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame([], schema).write.mode("append").parquet(source)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(schema).parquet(source))
        write = lambda df, _: out.extend(tuple(r) for r in df.collect())
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return out


def at(hours):
    return T0 + timedelta(hours=hours)


def test_changed_payloads_keep_a_return(spark, tmp_path):
    """One batch per file; started again with nothing new, and once more with a file that repeats the last payload."""
    schema, source = "provider string, fetched_at timestamp_ntz, seq long, sha256 string", str(tmp_path / "in")
    rows = [[("p", at(0), 1, "A"), ("q", at(0), 2, "X"), ("r", at(0), 3, None)], [("p", at(1), 4, "A"), ("p", at(2), 5, "B"), ("p", at(2), 6, "B")], [("p", at(3), 7, "A"), ("q", at(3), 8, "X"), ("r", at(3), 9, "Z")]]
    take = lambda: jobs.ingest_changes(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = [("p", 1, "A"), ("p", 5, "B"), ("p", 7, "A"), ("q", 2, "X"), ("r", 9, "Z")]
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        if k:
            got = take()
    for _ in range(2):
        assert sorted((r.provider, r.seq, r.sha256) for r in got.collect()) == want
        got = take()
    spark.createDataFrame([("p", at(9), 10, "A")], schema).coalesce(1).write.mode("append").parquet(source)
    assert take().count() == len(want)


def test_alarm_opens_repeats_and_recovers(spark, tmp_path):
    rows = [[("p", at(0), True)], [("p", at(47), False)], [("p", at(48), False)], [("p", at(60), False)], [("p", at(73), False)], [("p", at(80), True)], [("p", at(90), True)]]
    got = run(spark, tmp_path, rows, "provider string, at timestamp, ok boolean", jobs.alarms)
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: r[1])] == [(at(48), "stale"), (at(72), "still stale"), (at(80), "recovered")]
    assert {r[3] for r in got} == {at(48)}


def test_alarms_are_those_of_the_table(spark, tmp_path):
    rnd = random.Random(4)
    runs = sorted({(at(rnd.randrange(2000)), p, rnd.random() < 0.3) for p in ("p", "q", "r") for _ in range(25)})
    runs = [(p, t, ok) for (t, p), ok in {(t, p): ok for t, p, ok in runs}.items()]
    schema = "provider string, at timestamp, ok boolean"
    end = max(t for _, t, _ in runs)
    batches = [[r for r in runs if r[1] <= at(1000)], [r for r in runs if r[1] > at(1000)], [(p, end + timedelta(hours=1), False) for p in ("p", "q", "r")]]
    got = {r[:3] for r in run(spark, tmp_path, batches, schema, jobs.alarms) if r[1] <= end}
    want = {tuple(r)[:3] for r in limits.alarm_history(spark.createDataFrame(runs, schema), str(end)).collect()}
    assert got == want and {n for _, _, n in want} == {"stale", "still stale", "recovered"}


def test_rate_limit_ignores_rejected(spark, tmp_path):
    second = lambda s: T0 + timedelta(seconds=s)
    rows = [[(1, second(0)), (1, second(1)), (1, second(2))], [(1, second(59)), (1, second(61)), (2, second(61))]]
    got = run(spark, tmp_path, rows, "user long, at timestamp", lambda s: jobs.rate_limited(s, 2, 60))
    want = [(1, 0, True), (1, 1, True), (1, 2, False), (1, 59, False), (1, 61, True), (2, 61, True)]
    assert [(u, int((t - T0).total_seconds()), ok) for u, t, ok in sorted(got)] == want
    hits = spark.createDataFrame([(u, t, k) for k, (u, t) in enumerate(r for batch in rows for r in batch)], "user long, at timestamp, k long")
    table = limits.rate_limited(hits, "user", "at", "k", 2, 60).join(hits, ["user", "k"]).select("user", "at", "allowed")
    assert sorted(tuple(r) for r in table.collect()) == sorted(got)


def test_ingest_is_incremental(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    for k in range(2):
        spark.range(3 * k, 3 * k + 3).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            jobs.ingest(spark, source, "id long", target, str(tmp_path / "c"), lambda df: df.selectExpr("id * 2 AS id"))
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 2, 4, 6, 8, 10]


def test_windows_close_by_watermark(spark, tmp_path):
    rows = [[(at(0), "view"), (at(1), "view"), (at(7), "view")], [(at(30), "view")], [(at(31), "view")]]
    got = run(spark, tmp_path, rows, "ts timestamp, event_type string", lambda s: jobs.windowed_counts(s, "6 hours", "1 hour"))
    assert sorted(got) == [(at(0), "view", 2), (at(6), "view", 1)]
