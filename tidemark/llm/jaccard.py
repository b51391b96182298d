"""Exact Jaccard self-join of documents' word shingles by universe partition and pigeonhole.

A document is the set of its distinct five-word shingles, as 64-bit hashes. Sizes fall into bands. A band's layout deals
the universe of shingles, by hash, to segments. Two sets of Jaccard similarity 3/4 or more differ in at most H
shingles, so of a set's filled segments all but H are equal in both: each document indexes its segments under the
layout of its own band and of the lower bands that hold possible partners, and a pair is a candidate when it shares as many segments as the
layout's count asks. Where that is cheaper, some segments of a layout also index their one-deletion neighbourhood, and
then stand for two units of difference. `layout` chooses both numbers by a model of the cost.

A segment that more than HOT documents share is not paired up; a task that sees it more often sends on HOT + 1 of its entries and counts the rest. A
document that misses too many of its segments so, or has too many empty ones, is set apart; only pairs of two such documents are still open. They
meet under finer layouts in groups, and a group is verified whole, in blocks: members are dealt to blocks twice, which ties near copies
together, and what is then outside the group's largest component is compared with all of the group.

Every link is verified on the sets themselves. Rows with equal sets are one class. A class has a number of its own, in the order of its
smallest doc_id, and its text is that of one row; ids need not be unique.

Defined cases: a null text, or one without words, has no shingles and links with nothing; fewer words than five are one shingle; a
null doc_id keeps its size and has component null; rows that share a doc_id are documents of their own, which link by their own texts; an
empty table gives an empty result; further columns are ignored by `near_duplicates` and kept by `keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, fresh, lean, materialise
from tidemark.llm.graph import components

WORDS = 5
#: A segment shared by more documents than this is hot.
HOT = 48
#: Documents with different sets for each shard of the index, in a group of work inside a task, and in a block of the verification.
SHARD_DOCS, CHUNK_DOCS, CHUNK_TOKENS, BLOCK, BLOCK_TOKENS = 8192, 4096, 3_000_000, 1024, 2_000_000
BAND_RATIO = 1.5
#: Odd multipliers, one for each word of a shingle.
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(bytes([k])) | 1 for k in range(WORDS)], np.uint64)
_MEMORY = 400_000


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """The shingle set of a text, sorted. Hashes of words are remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) > _MEMORY:
                known.clear()
                new = set(words)
            known.update(zip(new, map(xxhash.xxh3_64_intdigest, new), strict=True))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - WORDS + 1
        total = h[:n] * _MULTIPLIERS[0]
        for k in range(1, WORDS):
            total += h[k : k + n] * _MULTIPLIERS[k]
        return np.unique(mix(total))


@cache
def band_starts(most: int = 1 << 26) -> np.ndarray:
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, math.ceil(starts[-1] * BAND_RATIO)))
    return np.array(starts)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(band_starts(), n, side="right") - 1


def differences(n: np.ndarray, band: int) -> np.ndarray:
    """H: the most shingles in which a set of size n and a partner may differ, the smaller of the two being in the band."""
    top = band_starts()[band + 1] - 1
    return (n + np.where(n <= top, n * 4 // 3, top)) // 7


@cache
def layout(band: int) -> tuple[int, int, int]:
    """(segments, segments with one-deletion neighbourhoods, equal segments that a pair must share).

    The cost of a layout is what a typical set of the band indexes. It must leave the largest set of the band enough
    capacity: a filled segment counts 1, one with a neighbourhood and two shingles or more counts 2, and three standard deviations are kept free.
    """
    low, top = int(band_starts()[band]), int(band_starts()[band + 1]) - 1
    asked = max(1, min(16, top // 24))
    need = int(differences(np.array([top]), band)[0]) + asked
    best = None
    for share in (0.0, 0.25, 0.5, 1.0):
        for m in (range(1, 4 * need + 9) if need < 200 else range(need // 2, 3 * need, max(1, need // 60))):
            doubled = math.ceil(share * m)
            enough = True
            for n in (low, top):
                x = n / m
                empty, one = math.exp(-x), x * math.exp(-x)
                room = m * (1 - empty) + doubled * (1 - empty - one)
                spread = math.sqrt(m * empty * max(0.0, 1 - (1 + x) * empty)) * (1 + share)
                if m == 1:
                    room, spread = 1 + doubled * (n > 1), 0
                enough &= room - 3 * spread >= int(differences(np.array([n]), band)[0]) + asked
            if enough:
                cost = m * (1 - math.exp(-top / m)) + doubled * top / m
                if best is None or cost < best[0]:
                    best = (cost, m, doubled)
                break
    _, m, doubled = best or (0, 4 * need + 8, 0)
    return m, doubled, asked


def signatures(sets: list[np.ndarray], band: int, attempt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets under one layout: signatures, which set each belongs to, and each set's capacity. Later attempts take four times the segments and no
    neighbourhoods."""
    m, doubled, _ = layout(band)
    if attempt:
        m, doubled = m * 4**attempt, 0
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    place = mix(tokens, 1 + band * 16 + attempt)
    segment = ((place >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    cell = owner.astype(np.uint64) * np.uint64(m) + segment
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    value = mix(tokens[order], 7)
    total = np.add.reduceat(value, begin)
    width = np.diff(np.r_[begin, len(cell)])
    of, seg = owner[order][begin], segment[order][begin]
    salt = mix(seg, 100_000 + band * 16 + attempt)
    found, whose = [mix(total ^ salt)], [of]
    room = np.ones(len(begin), np.int64)
    if doubled:
        wide = (seg < doubled) & (width > 1)
        room += wide
        rows = np.repeat(wide, width)
        found.append(mix((np.repeat(total, width) - value)[rows] ^ np.repeat(salt, width)[rows]))
        whose.append(owner[order][rows])
    return np.concatenate(found), np.concatenate(whose), np.bincount(of, room, minlength=len(sets)).astype(np.int64)


def bands_for(n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each layout and the sets, by number, that take part in it."""
    own, starts = band_of(n), band_starts()
    for band in range(int(own.max()) + 1 if len(n) else 0):
        top = starts[band + 1] - 1
        some = np.flatnonzero((own >= band) & (4 * np.minimum(n, top) >= 3 * n))
        if len(some):
            yield band, some


def blobs(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of each stretch of values, given where the stretches begin."""
    ends = (np.r_[begin, len(values)] * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def places(shard: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For entries sorted by shard: the slots that each shard uses, where a shard's used slots begin, and each entry's place among them."""
    pair = shard.astype(np.int64) * (int(slot.max()) + 1) + slot
    used, of = np.unique(pair, return_inverse=True)
    first = starts_of(used // (int(slot.max()) + 1))
    each = np.searchsorted(first, np.arange(len(used)), side="right") - 1
    return used % (int(slot.max()) + 1), first, of - first[each[of]]


def shard_of(sig: np.ndarray, shards: int) -> np.ndarray:
    return (((sig >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _distinct(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, str]]:
    """Number and text of the rows of a sorted stream; rows that repeat a number come once."""
    last = None
    for batch in batches:
        for i, text in zip(batch.column(column).to_pylist(), batch.column("text").to_pylist(), strict=True):
            if i != last:
                yield i, text
            last = i


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make, rows = Shingles(), []
    for i, text in _distinct(batches, "cls"):
        rows.append((i, make.of(text).tobytes()))
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["cls", "shingles"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["cls", "shingles"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Shingles()
    for batch in batches:
        sets = [make.of(t) for t in batch.column("text").to_pylist()]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "th", "n_shingles", "key"])


INDEX = "shard int, who long, lost long, spare_left long, ids binary, asked binary, spare binary, unit binary, sig binary, slot binary"


def _indexed(shards: int, hot: int):
    """Rows of a shard: slots (a class under a layout: its number, units asked, spare units, units of an entry) and the signatures with their slots. Rows without a
    shard: a class that is set apart, or with `lost` the units that it has in signatures which this task knows to be hot."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def alone(who: np.ndarray, lost: np.ndarray | None, spare: np.ndarray | None) -> pa.RecordBatch:
        n = len(who)
        some = [pa.nulls(n, pa.int64()) if x is None else pa.array(x.astype(np.int64)) for x in (lost, spare)]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(who), *some, *[pa.nulls(n, pa.binary())] * 6], names)

    def emit(ids: list[int], sets: list[np.ndarray], known: set[int]) -> Iterator[pa.RecordBatch]:
        n = np.array([len(s) for s in sets])
        asked = np.array([layout(int(b))[2] for b in range(int(band_of(n).max()) + 1)])
        ids = np.array(ids, np.int64)
        slots, found, whose = [], [], []
        base = 0
        for band, some in bands_for(n):
            sig, of, room = signatures([sets[i] for i in some], band)
            spare = room - differences(n[some], band) - layout(band)[2]
            if (spare < 0).any():
                yield alone(ids[some[spare < 0]], None, None)
            slots.append((ids[some], asked[band_of(n[some])], spare, np.full(len(some), 1 + (layout(band)[1] > 0))))
            found.append(sig)
            whose.append(of + base)
            base += len(some)
        ids, asked, spare, unit = [np.concatenate(x) for x in zip(*slots, strict=True)]
        sig, of = np.concatenate(found), np.concatenate(whose)
        order = np.argsort(sig, kind="stable")
        sig, of = sig[order], of[order]
        begin = starts_of(sig)
        width = np.diff(np.r_[begin, len(sig)])
        rank = np.arange(len(sig)) - np.repeat(begin, width)
        counted = np.repeat(width > hot, width) & (rank > hot)
        if known:
            counted |= np.isin(sig, np.fromiter(known, np.uint64, len(known)))
        known.update(sig[begin[width > hot]].tolist())
        if counted.any():
            at, times = np.unique(of[counted], return_counts=True)
            yield alone(ids[at], times * unit[at], spare[at])
            sig, of = sig[~counted], of[~counted]
        if not len(sig):
            return
        shard = shard_of(sig, shards)
        used, first, place = places(shard, of)
        begin = starts_of(shard)
        none = pa.nulls(len(begin), pa.int64())
        per_slot = [blobs(x, first) for x in (ids[used], asked[used].astype(np.uint16), np.clip(spare[used], -1, 30000).astype(np.int16), unit[used].astype(np.int16))]
        yield pa.RecordBatch.from_arrays([pa.array(shard[begin].astype(np.int32)), none, none, none, *per_slot, blobs(sig.astype(np.uint32), begin), blobs(place.astype(np.uint16), begin)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, ids, sets, held, known = Shingles(), [], [], 0, set()
        for i, text in _distinct(batches, "cls"):
            s = make.of(text)
            ids.append(i)
            sets.append(s)
            held += len(s)
            if len(ids) >= CHUNK_DOCS or held >= CHUNK_TOKENS:
                yield from emit(ids, sets, known)
                ids, sets, held = [], [], 0
        if ids:
            yield from emit(ids, sets, known)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key) -> Iterator[list[dict]]:
    """Rows of a sorted stream by key."""
    rows, at = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if rows and key(row) != at:
                yield rows
                rows = []
            at = key(row)
            rows.append(row)
    if rows:
        yield rows


def _pairs_of_runs(sig: np.ndarray, slot: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of slots with equal signatures, and the slots of each entry in a run of more than `hot`."""
    order = np.argsort(sig, kind="stable")
    sig, slot = sig[order], slot[order]
    begin = starts_of(sig)
    width = np.diff(np.r_[begin, len(sig)])
    each = np.repeat(width, width)
    is_hot = each > hot
    left, right = [], []
    cool = (each > 1) & ~is_hot
    s, o = sig[cool], slot[cool]
    for k in range(1, hot):
        same = s[k:] == s[:-k]
        if not same.any():
            break
        left.append(o[:-k][same])
        right.append(o[k:][same])
    none = np.zeros(0, np.int64)
    return np.concatenate(left) if left else none, np.concatenate(right) if right else none, slot[is_hot]


def _candidates(hot: int):
    """a, b, shared, asked for pairs; a, spare, lost for a document's entries in segments of more than `hot` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, lambda r: r["shard"]):
            ids, asked, spare, unit, sig, slot, base = [], [], [], [], [], [], 0
            for r in rows:
                own = np.frombuffer(r["ids"], np.int64)
                ids.append(own)
                asked.append(np.frombuffer(r["asked"], np.uint16))
                spare.append(np.frombuffer(r["spare"], np.int16))
                unit.append(np.frombuffer(r["unit"], np.int16))
                sig.append(np.frombuffer(r["sig"], np.uint32))
                slot.append(np.frombuffer(r["slot"], np.uint16).astype(np.int64) + base)
                base += len(own)
            rows.clear()
            ids, asked, spare, unit = (np.concatenate(x) for x in (ids, asked, spare, unit))
            left, right, lost = _pairs_of_runs(np.concatenate(sig), np.concatenate(slot), hot)
            a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
            least = np.minimum(asked[left], asked[right])
            real = a != b
            a, b, least = a[real], b[real], least[real]
            order = np.lexsort((b, a))
            a, b, least = a[order], b[order], least[order]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
            count = np.diff(np.r_[new, len(a)])
            at, times = np.unique(lost, return_counts=True)
            columns = [
                np.r_[a[new], ids[at]], np.r_[b[new], np.full(len(at), -1)], np.r_[count, times * unit[at]], np.r_[least[new], spare[at]],
                np.r_[np.zeros(len(new), bool), np.ones(len(at), bool)],
            ]
            for k in range(0, len(columns[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000], t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "shared", "asked", "hot"])

    return run


def _led(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the first document of each, and edges from it to the others."""
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    first = starts_of(sig)
    leader = np.repeat(who[first], np.diff(np.r_[first, len(sig)]))
    return sig[first], who[first], np.unique(np.stack([leader, who], axis=1)[leader != who], axis=0)


def _regroup(shards: int):
    """The documents set apart, under finer layouts whose capacity does suffice: edges (a, b) to the first document of each signature in the batch, and for a
    shard the signatures with that document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "sig", "who", "a", "b"]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("cls").to_numpy()
            sets = [np.frombuffer(b, np.uint64) for b in batch.column("shingles").to_pylist()]
            n = np.array([len(s) for s in sets])
            out_sig, out_id = [], []
            for band, some in bands_for(n):
                left, attempt = some, 1
                while len(left):
                    sig, of, room = signatures([sets[i] for i in left], band, attempt)
                    out_sig.append(sig)
                    out_id.append(ids[left][of])
                    left = left[room <= differences(n[left], band)]
                    attempt += 1
            sig, who, edges = _led(np.concatenate(out_sig), np.concatenate(out_id))
            shard = shard_of(sig, shards)
            begin, n = starts_of(shard), len(edges)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(edges[:, 0]), pa.array(edges[:, 1])], names)
            none = pa.nulls(len(begin), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shard[begin].astype(np.int32)), blobs(sig, begin), blobs(who, begin), none, none], names)

    return run


class Union:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, some: np.ndarray) -> None:
        roots = np.unique(self.root[some])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that span what meets in a signature of a shard."""
    for rows in _grouped(batches, lambda r: r["shard"]):
        sig = np.concatenate([np.frombuffer(r["sig"], np.uint64) for r in rows])
        who = np.concatenate([np.frombuffer(r["who"], np.int64) for r in rows])
        _, _, edges = _led(sig, who)
        for k in range(0, len(edges), 50_000):
            part = edges[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["a", "b"])


def links_in(sets: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """The component of each set, by number, under links of similarity 3/4 or more: exact. `known` has equal labels for sets of one component. Sets outside the
    largest component are compared with all others; those in it need not be, as what they link to is in it or has been compared."""
    n = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, code = np.unique(tokens, return_inverse=True)
    order = np.argsort(code, kind="stable")
    postings, at = owner[order], np.r_[0, np.cumsum(np.bincount(code))]
    start = np.r_[0, np.cumsum(n)]
    union, done = Union(len(sets)), np.zeros(len(sets), bool)
    if known is not None:
        _, first, of = np.unique(known, return_index=True, return_inverse=True)
        union.root = first[of]
    while not done.all():
        roots, of, count = np.unique(union.root, return_inverse=True, return_counts=True)
        outside = np.flatnonzero(~done & ((of != count.argmax()) if count.max() > 1 else True))
        if not len(outside):
            break
        for i in outside[: max(1, len(outside) // 2)]:
            mine = code[start[i] : start[i + 1]]
            length = at[mine + 1] - at[mine]
            spots = np.arange(length.sum()) + np.repeat(at[mine] - np.cumsum(length) + length, length)
            shared = np.bincount(postings[spots], minlength=len(sets))
            near = 100 * shared >= 75 * (n + n[i] - shared)
            done[i] = True
            if near.sum() > 1:
                union.join(np.flatnonzero(near))
    return union.root


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that tie the members of a cell to their components, as far as their labels do not tell them yet."""
    for rows in _grouped(batches, lambda r: (r["component"], r["i"], r["j"])):
        if len(rows) < 2:
            continue
        ids, labels = (np.array([r[c] for r in rows], np.int64) for c in ("cls", "label"))
        root = links_in([np.frombuffer(r["shingles"], np.uint64) for r in rows], labels)
        new = (root != np.arange(len(root))) & (labels != labels[root])
        yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(ids[root[new]])], ["a", "b"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows: doc_id, th (a hash of the text), n_shingles, key; and the classes: cls, key, n_shingles, and doc_id and th of the row that stands for it. Numbers
    follow the order of doc_id, so the smallest number of a component has its smallest id."""
    sizes = materialise(_rows(docs).mapInArrow(lean(_keys), "doc_id long, th long, n_shingles long, key binary"))
    firsts = sizes.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key", "n_shingles").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    return sizes, materialise(firsts.orderBy("first", "key").select(F.monotonically_increasing_id().alias("cls"), "key", "n_shingles", "first.doc_id", "first.th"))


def near_duplicates(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    sizes, classes = _classes(docs)
    linked = _linked(docs, classes, hot, block)
    tops = classes.select(F.col("cls").alias("component"), F.col("doc_id").alias("least"))
    roots = classes.join(linked.join(tops.hint("merge"), "component"), "cls", "left").select("key", F.coalesce("least", "doc_id").alias("component"))
    whole = sizes.join(roots, "key", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def _linked(docs: DataFrame, classes: DataFrame, hot: int, block: int) -> DataFrame:
    """cls, component of the classes with a link; the component is its smallest class."""
    count = classes.count()
    if count < 2:
        return classes.where("false").select("cls", F.col("cls").alias("component"))

    def texts(of: DataFrame | None = None) -> DataFrame:
        """Class and text of all classes or of some, by one row's id and hash."""
        wanted = classes.select("cls", "doc_id", "th")
        wanted = wanted if of is None else wanted.join(of, "cls", "left_semi")
        return _rows(docs).join(wanted.hint("merge"), ["doc_id", "th"]).select("cls", "text")

    shards = max(1, -(-count // SHARD_DOCS))
    index = materialise(texts().mapInArrow(lean(_indexed(shards, hot)), INDEX))
    met = index.where("shard IS NOT NULL").drop("who", "lost", "spare_left").repartitionById(shards, "shard").sortWithinPartitions("shard")
    met = materialise(met.mapInArrow(lean(_candidates(hot)), "a long, b long, shared long, asked long, hot boolean"))
    pairs = materialise(met.where("NOT hot").groupBy("a", "b").agg(F.sum("shared").alias("n"), F.min("asked").alias("m")).where("n >= m").select("a", "b"))
    lost = met.where("hot").select("a", "shared", "asked").union(index.where("shard IS NULL AND lost IS NOT NULL").select("who", "lost", "spare_left"))
    short = lost.groupBy("a").agg(F.sum("shared").alias("lost"), F.min("asked").alias("spare")).where("lost > spare").select(F.col("a").alias("cls"))
    apart = materialise(index.where("shard IS NULL AND lost IS NULL").select(F.col("who").alias("cls")).union(short).distinct())
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(apart).distinct()
    sets = materialise(texts(wanted).mapInArrow(lean(_sets), "cls long, shingles binary").dropDuplicates(["cls"]))
    n_apart = apart.count()
    edges = pairs
    if n_apart > 1:
        fine = max(1, -(-n_apart // (SHARD_DOCS // 4)))
        regrouped = materialise(sets.join(apart, "cls", "left_semi").mapInArrow(lean(_regroup(fine)), "shard int, sig binary, who binary, a long, b long"))
        led = regrouped.where("shard IS NOT NULL").repartitionById(fine, "shard").sortWithinPartitions("shard").mapInArrow(lean(_spanning), "a long, b long")
        edges = edges.union(regrouped.where("shard IS NULL").select("a", "b")).union(led)
    groups = components(edges).select(F.col("id").alias("cls"), F.col("component").alias("group"))
    return _verify(groups, sets, classes, block).select(F.col("id").alias("cls"), "component")


def _verify(groups: DataFrame, sets: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Components of the links inside the groups (cls, group): id, component."""
    members = materialise(groups.join(classes.select("cls", "n_shingles"), "cls"))
    size = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_TOKENS)))
    large = materialise(members.groupBy("group").agg(size.cast("int").alias("blocks")).where("blocks > 1"))
    dealt = members.join(large, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    part = lambda salt, n: F.pmod(F.xxhash64("cls", F.lit(salt)), n).cast("int")

    def links(cells: DataFrame) -> DataFrame:
        work = cells.join(sets.hint("merge"), "cls").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "cls")
        return materialise(work.mapInArrow(lean(_verified), "a long, b long"))

    twice = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array(part(0, F.col("blocks")), F.col("blocks") + part(1, F.col("blocks")))))
    first = links(dealt.select("cls", F.col("group").alias("component"), twice.alias("i"), F.lit(0).alias("j"), F.col("cls").alias("label")))
    known = components(first)
    if large.isEmpty():
        return known
    many = members.join(large, "group").join(known.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "group", "blocks", F.coalesce("component", "cls").alias("label"))
    many = materialise(many)
    top = materialise(many.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("top")))
    outside = materialise(many.join(top, "group").where("label <> top").drop("top"))
    columns = materialise(outside.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("columns")))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = many.join(columns, "group").select("cls", "group", "label", part(0, F.col("blocks")).alias("i"), numbers(F.col("columns")).alias("j"))
    beside = outside.join(columns, "group").select("cls", "group", "label", numbers(F.col("blocks")).alias("i"), part(2, F.col("columns")).alias("j"))
    cells = rows.union(beside).distinct().select("cls", F.col("group").alias("component"), "i", "j", "label")
    return components(first.union(links(cells)))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component one row stays, one with the smallest id, with all its columns; rows without id or shingles stay too."""
    own, th, row = (fresh(docs, x) for x in ("id", "th", "row"))
    _, classes = _classes(docs)
    gone = _linked(docs, classes, HOT, BLOCK).where("cls <> component").select("cls")
    kept = classes.join(gone, "cls", "left_anti").select(F.col("doc_id").alias(own), F.col("th").alias(th))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col("doc_id").isNotNull()
    keyed = docs.where(worded).withColumns({own: F.col("doc_id").cast("long"), th: F.xxhash64("text")})
    met = keyed.join(kept.hint("merge"), [own, th], "left_semi").withColumn(row, F.row_number().over(Window.partitionBy(own, th).orderBy(own)))
    return met.where(F.col(row) == 1).select(*docs.columns).union(docs.where(~worded))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(doc_id, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.top FROM r JOIN (SELECT x, y FROM l UNION ALL SELECT y, x FROM l) e ON e.x = r.doc_id WHERE r.top < e.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, t.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(top) AS component_id FROM r GROUP BY doc_id) t USING (doc_id)
"""
