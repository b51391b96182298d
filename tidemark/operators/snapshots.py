"""Mutations as new snapshots: old table and changes in, new table out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: in spark.checkpoint.dir, else in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Written to a shared folder and read again: steps that repeat start from a table."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; struct comparison decides, so one pass without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return last.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key, whole."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old rows stay; of new ones with a new key, the first comes in."""
    first = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.join(old.select(*keys), keys, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return old.unionByName(fresh)


def patch(old: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Tri-state patch: changes has, for each column c, c and `set_c`; null with set_c clears, without it keeps."""
    ch = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"set_{c}").alias(f"_set_{c}") for c in columns])
    rows = old.join(ch, keys, "left")
    out = {c: F.when(F.coalesce(F.col(f"_set_{c}"), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return rows.withColumns(out).select(*old.columns)


def fill_null(old: DataFrame, found: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only nulls are filled, from one found row per key."""
    add = found.groupBy(*keys).agg(*[F.min(c).alias(f"_{c}") for c in columns])
    return old.join(add, keys, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).select(*old.columns)


def delete_cascade(tables: dict[str, DataFrame], root: str, gone: DataFrame, children: dict[str, list[tuple[str, str, str]]]) -> dict[str, DataFrame]:
    """Delete rows of a table and, by foreign keys, of its children. children[table] lists (child, its column, the table's column)."""
    out = dict(tables)
    key = gone.columns
    lost = out[root].join(gone, key, "left_semi")
    out[root] = out[root].join(gone, key, "left_anti")
    for child, column, own in children.get(root, []):
        ids = lost.select(F.col(own).alias(column)).distinct()
        orphans = out[child].join(ids, column, "left_semi").select(*[c for c in out[child].columns if c == column or c.endswith("_id")]).distinct()
        out = delete_cascade(out, child, orphans, children)
    return out


def retained(events: DataFrame, now: str, days: int, floor: int) -> Column:
    """Rows that retention keeps: undated ones, and those that end on or after the cutoff, never nearer than the floor."""
    cutoff = F.date_sub(F.lit(now).cast("date"), max(days, floor))
    end = F.coalesce(events["date_exact"], events["date_end"], events["window_end"])
    return (events["kind"] == "TBD") | (end >= cutoff)


def slugs(sets: DataFrame, base: Column) -> DataFrame:
    """A slug for each set, unique in its install: the first by id has the base, the others the base and their id."""
    w = Window.partitionBy("install_id", "_base").orderBy("set_id")
    named = sets.withColumn("_base", base).withColumn("_n", F.row_number().over(w))
    return named.withColumn("slug", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("set_id").cast("string")))).drop("_base", "_n")
