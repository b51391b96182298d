"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal when their bytes are equal after lower-casing A-Z (a null text counts as empty). The index has one
entry for each distinct text. Its directory is made first, from the distinct hashes: it doubles until each bucket, a range of hash
values, holds at most `bucket_capacity` of them. Rows then get their bucket; copies combine within a task, by bytes, before they move, so no bucket
grows with the number of copies. Owner tasks take ranges of buckets, chain the entries that share a hash, and write them by bucket.

A row finds its entry by bucket and hash. A hash that one entry has decides by itself, as every row's text is in the index; in a chain the bytes
are compared, with the texts of the chains alone.

Defined cases: a null doc_id counts as smaller than any other; a group with null ids alone has keep_id null and keeps one row; rows
that repeat doc_id and text are rows of the group, of which one is kept; an empty table gives an empty result;
further columns are ignored by `dedup_report` and kept by `drop_copies`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, documents, fresh, materialise

#: Bits of the hash that the finest directory distinguishes; it has at most 2 ** 16 slots, whatever the input.
MAX_DEPTH = 16
BUCKET_CAPACITY = 250_000
HASH_BITS = 64
#: Rows that repeat id and text are written out in pieces of so many.
PIECE = 10_000


@dataclass(frozen=True)
class ExactIndex:
    """entries: bucket, hash, chain, length (of the chain), sha256, keep_id, group_size, on files by bucket; starts: the first slot of each bucket, ascending;
    chained: the entries of chains of two or more with their texts, None where there are none."""

    entries: DataFrame
    starts: list[int]
    bits: int
    chained: DataFrame | None


def _norm() -> Column:
    return ascii_lower(F.coalesce(F.col("text"), F.lit("")))


def _hashed(norm: Column, bits: int) -> Column:
    """The first bits of the hash; fewer than 64 only where tests want chains."""
    whole = F.xxhash64(norm)
    return whole if bits == HASH_BITS else F.shiftleft(F.shiftrightunsigned(whole, HASH_BITS - bits), HASH_BITS - bits)


def _keyed(docs: DataFrame, bits: int) -> DataFrame:
    return docs.select("doc_id", _norm().alias("norm")).withColumn("hash", _hashed(F.col("norm"), bits))


def _slot(hashed: Column, depth: int = MAX_DEPTH) -> Column:
    return F.shiftrightunsigned(hashed, 64 - depth)


def directory(slot_counts: dict[int, int], capacity: int) -> list[int]:
    """First finest slot of each bucket. Start with one bucket; double the directory while a bucket overflows, and
    split the overfull ones in halves."""
    before = list(accumulate((slot_counts.get(s, 0) for s in range(1 << MAX_DEPTH)), initial=0))
    buckets, depth = {0: before[-1]}, 0
    while depth < MAX_DEPTH and any(n > capacity for n in buckets.values()):
        depth, halves = depth + 1, {}
        half = 1 << (MAX_DEPTH - depth)
        for start, n in buckets.items():
            if n <= capacity:
                halves[start] = n
                continue
            upper = before[start + 2 * half] - before[start + half]
            halves |= {start: n - upper, start + half: upper}
        buckets = halves
    return sorted(buckets)


def _bucket(hashed: Column, starts: list[int]) -> Column:
    """The number of the bucket whose range holds the hash: a tree of ranges, or for many buckets an array of 2 ** 16 numbers, one per
    slot, which is written as one text so that it folds to one literal."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(slot < starts[mid], tree(lo, mid - 1)).otherwise(tree(mid, hi))

    slot = _slot(hashed)
    if len(starts) <= 64:
        return tree(0, len(starts) - 1)
    by_slot, at = [], 0
    for s in range(1 << MAX_DEPTH):
        at += at + 1 < len(starts) and starts[at + 1] <= s
        by_slot.append(at)
    return F.element_at(F.split(F.lit(",".join(map(str, by_slot))), ",").cast("array<int>"), slot.cast("int") + 1)


def build_index(docs: DataFrame, bucket_capacity: int = BUCKET_CAPACITY, bits: int = HASH_BITS) -> ExactIndex:
    """Make the directory, then give the buckets to owner tasks, which chain and write their entries."""
    keyed = _keyed(docs, bits)
    slots = keyed.select("hash").distinct().groupBy(_slot(F.col("hash")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    starts = directory({r["slot"]: r["n"] for r in slots.collect()}, bucket_capacity)
    groups = keyed.groupBy(_bucket(F.col("hash"), starts).alias("bucket"), "hash", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    owned = groups.select("bucket", "hash", F.sha2("norm", 256).alias("sha256"), "keep_id", "group_size").repartitionByRange("bucket", "hash")
    same = Window.partitionBy("bucket", "hash")
    entries = owned.withColumns({"chain": F.row_number().over(same.orderBy("sha256")), "length": F.count(F.lit(1)).over(same)})
    entries = materialise(entries, partition_by=["bucket"])
    chains = entries.where("length > 1").select("bucket", "hash", "chain", "sha256", "keep_id", "group_size")
    if chains.isEmpty():
        return ExactIndex(entries, starts, bits, None)
    texts = keyed.join(chains.select("hash").distinct(), "hash", "left_semi").select("hash", "norm").distinct()
    return ExactIndex(entries, starts, bits, materialise(texts.withColumn("sha256", F.sha2("norm", 256)).join(chains, ["hash", "sha256"])))


def probe(docs: DataFrame, index: ExactIndex) -> DataFrame:
    """doc_id, piece, rows, bucket, chain, sha256, keep_id, group_size: rows of docs, which must be those of the index, with their entry. Rows that repeat id and text come as
    pieces of at most PIECE rows; Spark splits a bucket's range that copies make too large."""

    def pieces(keys: DataFrame) -> DataFrame:
        one = keys.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {PIECE}"))))
        return one.withColumn("rows", F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE).cast("int")).drop("n")

    found = ["doc_id", "piece", "rows", "bucket", "chain", "sha256", "keep_id", "group_size"]
    keyed = _keyed(docs, index.bits)
    plain = keyed if index.chained is None else keyed.join(index.chained.select("hash").distinct(), "hash", "left_anti")
    keys = plain.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", _bucket(F.col("hash"), index.starts))
    alone = pieces(keys).join(index.entries.where("length = 1"), ["bucket", "hash"]).select(*found)
    if index.chained is None:
        return alone
    chained = keyed.join(index.chained.select("hash").distinct(), "hash", "left_semi").groupBy("doc_id", "hash", "norm").agg(F.count(F.lit(1)).alias("n"))
    return alone.unionByName(pieces(chained).join(index.chained.drop("sha256").withColumn("sha256", F.sha2("norm", 256)), ["hash", "norm"]).select(*found))


def dedup_report(docs: DataFrame, bucket_capacity: int = BUCKET_CAPACITY, bits: int = HASH_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    found = probe(docs, build_index(docs, bucket_capacity, bits))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("piece") == 0) & (F.col("copy") == 1)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha256").alias("text_sha256"), "bucket", "chain")


def drop_copies(docs: DataFrame, bucket_capacity: int = BUCKET_CAPACITY, bits: int = HASH_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns: those that the index names, by bucket and hash, in chains by bytes."""
    index = build_index(docs, bucket_capacity, bits)
    keep, h, bucket, norm, row = [fresh(docs, n) for n in ("keep", "hash", "bucket", "norm", "row")]
    keyed = docs.withColumn(h, _hashed(_norm(), bits)).withColumns({keep: F.col("doc_id"), bucket: _bucket(F.col(h), index.starts)})

    def staying(rows: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
        same = [rows[c].eqNullSafe(entries[c]) for c in keys]
        stay = rows.join(entries.hint("merge"), reduce(and_, same), "left_semi")
        return stay.withColumn(row, F.row_number().over(Window.partitionBy(*keys).orderBy(keep))).where(F.col(row) == 1).select(*docs.columns)

    named = {"keep_id": keep, "hash": h, "bucket": bucket, "norm": norm}
    alone = index.entries.where("length = 1").select(*[F.col(c).alias(named[c]) for c in ("bucket", "hash", "keep_id")])
    if index.chained is None:
        return staying(keyed, alone, [bucket, h, keep])
    hashes = index.chained.select(F.col("hash").alias(h)).distinct()
    chained = index.chained.select(*[F.col(c).alias(named[c]) for c in ("hash", "norm", "keep_id")])
    some = keyed.withColumn(norm, _norm()).join(hashes, h, "left_semi")
    return staying(keyed, alone, [bucket, h, keep]).unionByName(staying(some, chained, [h, norm, keep]))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
