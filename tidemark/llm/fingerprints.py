"""Document fingerprints: a canonical exact digest.

A text's canonical form is its Unicode compatibility composition, case-folded, with runs of white space as one blank.
Its fingerprint is the 128-bit xxhash of that form. Texts with equal hashes meet in a bucket, where their bytes are
compared: the first form in byte order keeps the plain hash, another form with the same hash gets a suffix. So documents
have equal fingerprints if and only if they have equal canonical forms. An edited text whose hash a document has is compared with that document's form the same way.

Defined cases: a null text is empty; ids that repeat are ordered by text; a null id comes last in descending order; a table of one row is its own
next; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialise

BITS = 128
#: The filter of hashes that are compared by bytes has 2 ** 22 bits to 2 ** 27 (16 MB), about 16 for each such hash.
FILTER_BITS = (22, 27)
#: Rows that a task holds as Python objects at a time.
STEP = 1000


def canonical(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes, bits: int = BITS) -> str:
    return f"{xxhash.xxh3_128_intdigest(form) >> (BITS - bits):032x}"


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def suspects(own: DataFrame, edited: DataFrame) -> DataFrame:
    """fingerprint, foreign: the documents' hashes that occur more than once, or as the hash of an edited text of another document too (foreign)."""
    both = own.select("fingerprint", F.lit(0).alias("e")).unionByName(edited.select("fingerprint", F.lit(1).alias("e")))
    counted = both.groupBy("fingerprint").agg(F.count_if(F.col("e") == 0).alias("n"), F.max("e").alias("e"))
    return materialise(counted.where("n > 0 AND n + e > 1").select("fingerprint", (F.col("e") == 1).alias("foreign")))


def hash_filter(found: DataFrame) -> tuple[int, dict[int, bytes]]:
    """Bits at the places of the hashes found. Its size is bounded by FILTER_BITS; a full filter lets more pass."""
    low, high = FILTER_BITS
    bits = min(high, max(low, (16 * found.count()).bit_length()))
    place = F.crc32("fingerprint") % (1 << bits) + 1  # bits and buckets count from 1
    parts = found.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    return bits, {int(r["b"]): bytes(r["bits"]) for r in parts.collect()}


def collisions(docs: DataFrame, own: DataFrame, edited: DataFrame, bits: int = BITS) -> DataFrame:
    """fingerprint, form, rank for the hashes that different canonical forms share, or a document and another's edited text. Forms are made for the
    documents with such a hash, and grouped by hash and bytes."""
    found = suspects(own, edited)
    size, filled = hash_filter(found)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in (b.slice(a, STEP) for b in batches for a in range(0, b.num_rows, STEP)):
            rows = []
            for text in batch.column("text").to_pylist():
                form = canonical(text)
                key = digest(form, bits)
                place = zlib.crc32(key.encode()) % (1 << size)
                part = shared.value.get(place // 32768 + 1)
                if part and part[place % 32768 // 8] >> place % 8 & 1:
                    rows.append((key, form))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["fingerprint", "form"])

    distinct = docs.select("text").mapInArrow(forms, "fingerprint string, form binary").groupBy("fingerprint", "form").agg(F.count(F.lit(1)).alias("n"))
    several = Window.partitionBy("fingerprint")
    ranked = distinct.withColumn("_n", F.count(F.lit(1)).over(several)).withColumn("rank", F.row_number().over(several.orderBy("form")) - 1)
    foreign = found.where("foreign").select("fingerprint", "foreign")
    return materialise(ranked.join(foreign, "fingerprint", "left").where("_n > 1 OR foreign").select("fingerprint", "form", "rank"))


def fingerprint_pairs(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Each document with the next one in descending order of ids: doc_id, next_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The table is dealt to ranges of ids and each range is sorted. Within a range a task sees neighbours one after the
    other; the first text and the last row of each range go on to a small table, which joins the ranges up.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 10_000).alias("c")).first()["c"] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in (b.slice(a, STEP) for b in batches for a in range(0, b.num_rows, STEP)):
            ids = batch.column("doc_id")
            part = np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, np.searchsorted(cuts, ids.fill_null(0).to_numpy(), side="right"))
            texts = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(len(cuts) - part, pa.int32()), ids, pa.array(texts, pa.binary())], ["part", "doc_id", "z"])

    def row(doc: tuple, following: tuple) -> tuple:
        (i, text, form), (j, text2, form2) = doc, following
        edited = edit(text, text2)
        form3 = canonical(edited)
        return (i, j, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(form, bits), digest(form3, bits), float(form == form3), float(form == form2), None, None, None)

    names = ["doc_id", "next_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "head", "tail"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
    schema = "doc_id long, next_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, head binary, tail binary"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def opened(unpack, i: int | None, z: bytes) -> tuple:
        text = unpack(z).decode("utf-8", "surrogatepass")
        return i, text, canonical(text)

    def edge(part: int, i: int | None, **z: bytes) -> tuple:
        return (i, *[None] * 7, part, z.get("head"), z.get("tail"))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        part, last, last_z = None, None, None
        for batch in (b.slice(a, STEP) for b in batches for a in range(0, b.num_rows, STEP)):
            rows = []
            for p, i, z in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                doc = opened(unpack, i, z)
                if p != part:
                    if last is not None:
                        rows.append(edge(part, last[0], tail=last_z))
                    rows.append(edge(p, i, head=z))
                else:
                    rows.append(row(last, doc))
                part, last, last_z = p, doc, z
            yield batch_of(rows)
        if last is not None:
            yield batch_of([edge(part, last[0], tail=last_z)])

    dealt = docs.select("doc_id", "text").mapInArrow(squeeze, "part int, doc_id long, z binary").repartitionById(len(cuts) + 2, "part")
    found = materialise(dealt.sortWithinPartitions("part", F.col("doc_id").desc_nulls_last(), "z").mapInArrow(neighbours, schema))
    heads = found.where("head IS NOT NULL").select("part", F.col("doc_id").alias("next_id"), "head")
    order = heads.select("part")
    following = order.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("after"))
    tails = found.where("tail IS NOT NULL").select("part", "doc_id", "tail").join(following, "part")
    joined = tails.alias("t").join(heads.alias("h"), F.expr("t.after = h.part")).select("t.doc_id", "t.tail", "next_id", "head")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield batch_of([row(opened(unpack, i, z), opened(unpack, j, y)) for i, z, j, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)])

    whole = found.where("head IS NULL AND tail IS NULL").unionByName(joined.mapInArrow(finish, schema))
    plain = materialise(whole.select(*names[:8]))
    edited = plain.where("near_edited < 1").select(F.col("edited_fingerprint").alias("fingerprint"))
    clashes = collisions(docs, plain.select("fingerprint"), edited, bits)
    return plain if clashes.isEmpty() else _discriminate(plain, docs, clashes, bits)


def _discriminate(plain: DataFrame, docs: DataFrame, clashes: DataFrame, bits: int) -> DataFrame:
    """Give colliding forms their suffix. Only rows with a colliding hash fetch their texts again."""
    bad = clashes.select(F.col("fingerprint").alias("bad")).distinct()
    rows = plain.withColumn("_row", F.sha2(F.concat_ws("|", "doc_id", F.lit("/"), "next_id", "n_chars", "edited_sha256", "fingerprint", "near_next"), 256))
    hit = rows.join(bad, F.col("bad").isin(F.col("fingerprint"), F.col("edited_fingerprint")), "left_semi")
    ids = hit.select(F.explode(F.array("doc_id", "next_id")).alias("id")).distinct()
    texts = docs.join(ids.hint("merge"), docs["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    pairs = hit.distinct().alias("r").join(texts.alias("a"), F.expr("r.doc_id <=> a.doc_id AND r.n_chars = length(a.text)")).join(texts.alias("b"), F.expr("r.next_id <=> b.doc_id"))
    pairs = pairs.select("r._row", "r.fingerprint", "r.edited_sha256", F.col("a.text").alias("own"), F.col("b.text").alias("after"))

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():  # ids that repeat: keep the texts that the row was made of
                form, edited = canonical(r["own"]), edit(r["own"], r["after"])
                if digest(form, bits) == r["fingerprint"] and hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest() == r["edited_sha256"]:
                    made.append((r["_row"], form, canonical(edited)))
            columns = list(zip(*made, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["_row", "form", "form3"])

    made = pairs.mapInArrow(forms, "_row string, form binary, form3 binary").dropDuplicates(["_row"])
    count = clashes.groupBy("fingerprint").agg((F.max("rank") + 1).alias("unlisted"))
    out = rows.join(made, "_row", "left")
    for key, form in (("fingerprint", "form"), ("edited_fingerprint", "form3")):
        c, n = clashes.alias("c"), count.alias("n")
        out = (
            out.alias("o").join(c, F.expr(f"o.{key} = c.fingerprint AND o.{form} = c.form"), "left").join(n, F.expr(f"o.{key} = n.fingerprint"), "left")
            .withColumn("_suffix", F.when(F.col("n.unlisted").isNull(), F.lit("")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("c.rank"), F.col("n.unlisted")).cast("string"))))
            .withColumn("_key", F.concat(F.col(f"o.{key}"), F.when(F.col("_suffix") == "-0", F.lit("")).otherwise(F.col("_suffix"))))
            .select(*[F.col(f"o.{x}") for x in out.columns if x != key], F.col("_key").alias(key))
        )
    return out.select(*plain.columns)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(documents(spark, sf_dir)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
