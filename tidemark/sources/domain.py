"""The domain's tables from the star schema at hand, and the SQL of the same views.

Each view is a function of (spark, folder); SQL[name] says the same for an engine that has the base tables as views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import ORIGINS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(column, *values):
    """values[k] for a column's value k."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), column.cast("int") + 1)


def installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("install_id"), F.regexp_replace(F.lower("r_name"), " ", "-").alias("slug"), F.initcap("r_name").alias("game"), (F.col("r_regionkey") != 4).alias("enabled")
    )


def product_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("set_id"),
        (F.col("p_partkey") % 5).cast("int").alias("install_id"),
        F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit("-"), "p_type").alias("code"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


def release_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = read(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", "r_name")
    who = read(spark, sf_dir, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).select("c_custkey", "r_name")
    orders = read(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate")).withColumn("k", F.col("o_orderkey") % 4)
    region = F.create_map(*[F.lit(x) for x in ("AFRICA", "OTHER", "AMERICA", "NA", "ASIA", "APAC", "EUROPE", "EU", "MIDDLE EAST", "GLOBAL")])
    return orders.join(who, F.expr("o_custkey = c_custkey")).select(
        F.col("o_orderkey").alias("event_id"),
        (F.col("o_orderkey") % sets).alias("set_id"),
        F.when(F.col("o_orderstatus") == "F", "SHELF").when(F.col("o_orderstatus") == "O", "PRERELEASE").otherwise("PROMO").alias("type"),
        pick(F.substring("o_orderpriority", 1, 1).cast("int") - 1, "CONFIRMED", "ANNOUNCED", "RUMORED", "RELEASED", "CANCELLED").alias("status"),
        region[F.col("r_name")].alias("region"),
        pick(F.col("k"), "EXACT", "RANGE", "WINDOW", "TBD").alias("kind"),
        F.when(F.expr("k = 0"), F.col("d")).alias("date_exact"),
        F.when(F.expr("k = 1"), F.col("d")).alias("date_start"),
        F.when(F.expr("k = 1"), F.date_add("d", 10)).alias("date_end"),
        F.when(F.expr("k = 2"), "MONTH").alias("granularity"),
        F.when(F.expr("k = 2"), F.trunc("d", "month")).alias("window_start"),
        F.when(F.expr("k = 2"), F.last_day("d")).alias("window_end"),
        F.col("d").alias("updated_on"),
        (F.col("o_orderkey") % 17 == 0).alias("archived"),
        (F.col("o_orderkey") % 13 == 0).alias("is_override"),
    )


def _claims(lineitem: DataFrame, *more: Column) -> DataFrame:
    names, tiers = [o[0] for o in ORIGINS], [o[1] for o in ORIGINS]
    at = F.col("l_suppkey") % len(ORIGINS)
    return lineitem.select(
        F.col("l_orderkey").alias("event_id"),
        F.col("l_linenumber").alias("run"),
        pick(at, *names).alias("origin"),
        pick(at, *tiers).alias("tier"),
        F.to_date("l_shipdate").alias("claim_date"),
        (1 - F.col("l_discount")).alias("weight"),
        (F.col("l_returnflag") == "N").alias("live"),
        (F.col("l_quantity") % 10).cast("int").alias("runs"),
        F.col("l_partkey").alias("ref"),
        *more,
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(read(spark, sf_dir, "lineitem"))


def placed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims with their place in the table, in which order an engine that reads it row by row multiplies weights."""
    return _claims(read(spark, sf_dir, "lineitem"), F.struct("_metadata.file_name", "_metadata.row_index").alias("place"))


def provider_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in ("view", "OK", "click", "OK", "signup", "NOT_MODIFIED", "purchase", "DEGRADED", "error", "FAILED")])
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        (F.col("user_id") % 11).alias("provider"),
        kinds[F.col("event_type")].alias("status"),
        F.col("ts").alias("started_at"),
        (F.col("event_id") % 40).alias("scan_id"),
        F.col("value"),
        F.col("props"),
    )


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in ("view", "like", "click", "love", "signup", "wow", "purchase", "sad", "error", "angry")])
    return read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 500).alias("target_id"), kinds[F.col("event_type")].alias("emoji"), F.col("ts"), "event_id")


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 5).cast("int").alias("install_id"), (F.col("c_acctbal") > 0).alias("premium"), (F.col("c_mktsegment") != "MACHINERY").alias("alerts")
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("url_key"), F.col("source"), F.col("doc_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int")).alias("published_on"), F.split("text", "\n")[0].alias("title"), F.col("lang")
    )


_ORIGIN = "CASE l_suppkey % 12 " + " ".join(f"WHEN {k} THEN '{o[0]}'" for k, o in enumerate(ORIGINS)) + " END"
_TIER = "CASE l_suppkey % 12 " + " ".join(f"WHEN {k} THEN '{o[1]}'" for k, o in enumerate(ORIGINS)) + " END"

SQL = {
    "installs": "SELECT r_regionkey AS install_id, replace(lower(r_name), ' ', '-') AS slug, CASE r_name WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(r_name[1]) || lower(r_name[2:]) END AS game, r_regionkey <> 4 AS enabled FROM region",
    "product_sets": "SELECT p_partkey AS set_id, CAST(p_partkey % 5 AS INTEGER) AS install_id, p_name AS name, p_brand || '-' || p_type AS code, p_size AS size, p_retailprice AS price FROM part",
    "release_events": """SELECT o_orderkey AS event_id, o_orderkey % (SELECT count(*) FROM part) AS set_id,
      CASE o_orderstatus WHEN 'F' THEN 'SHELF' WHEN 'O' THEN 'PRERELEASE' ELSE 'PROMO' END AS type,
      CASE o_orderpriority[1] WHEN '1' THEN 'CONFIRMED' WHEN '2' THEN 'ANNOUNCED' WHEN '3' THEN 'RUMORED' WHEN '4' THEN 'RELEASED' ELSE 'CANCELLED' END AS status,
      CASE r_name WHEN 'AFRICA' THEN 'OTHER' WHEN 'AMERICA' THEN 'NA' WHEN 'ASIA' THEN 'APAC' WHEN 'EUROPE' THEN 'EU' ELSE 'GLOBAL' END AS region,
      CASE o_orderkey % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'RANGE' WHEN 2 THEN 'WINDOW' ELSE 'TBD' END AS kind,
      CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS date_exact,
      CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderdate AS DATE) END AS date_start,
      CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderdate AS DATE) + 10 END AS date_end,
      CASE WHEN o_orderkey % 4 = 2 THEN 'MONTH' END AS granularity,
      CASE WHEN o_orderkey % 4 = 2 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS window_start,
      CASE WHEN o_orderkey % 4 = 2 THEN last_day(CAST(o_orderdate AS DATE)) END AS window_end,
      CAST(o_orderdate AS DATE) AS updated_on, o_orderkey % 17 = 0 AS archived, o_orderkey % 13 = 0 AS is_override
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "claims": f"""SELECT l_orderkey AS event_id, l_linenumber AS run, {_ORIGIN} AS origin, {_TIER} AS tier, CAST(l_shipdate AS DATE) AS claim_date,
      1 - l_discount AS weight, l_returnflag = 'N' AS live, CAST(l_quantity % 10 AS INTEGER) AS runs, l_partkey AS ref FROM lineitem""",
    "provider_runs": """SELECT event_id AS run_id, user_id % 11 AS provider,
      CASE event_type WHEN 'view' THEN 'OK' WHEN 'click' THEN 'OK' WHEN 'signup' THEN 'NOT_MODIFIED' WHEN 'purchase' THEN 'DEGRADED' ELSE 'FAILED' END AS status,
      ts AS started_at, event_id % 40 AS scan_id, value, props FROM events""",
    "reactions": """SELECT user_id, event_id % 500 AS target_id,
      CASE event_type WHEN 'view' THEN 'like' WHEN 'click' THEN 'love' WHEN 'signup' THEN 'wow' WHEN 'purchase' THEN 'sad' ELSE 'angry' END AS emoji, ts, event_id FROM events""",
    "subscriptions": "SELECT c_custkey AS user_id, CAST(c_nationkey % 5 AS INTEGER) AS install_id, c_acctbal > 0 AS premium, c_mktsegment <> 'MACHINERY' AS alerts FROM customer",
    "news": "SELECT sha256(text) AS url_key, source, doc_id, DATE '2024-01-01' + CAST(doc_id % 200 AS INTEGER) AS published_on, string_split(text, chr(10))[1] AS title, lang FROM documents",
}


def sql(body: str) -> str:
    """body with the views that it names in front of it."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in body)
    body = body.strip()
    if not views:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{views}, {body.removeprefix(head)}"
    return f"WITH {views}\n{body}"
