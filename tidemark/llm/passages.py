"""Substring deduplication: fuzzy passages that repeat across documents, by collinear chaining.

Seeds are the words of SEED in a window of K words, one word left free, and whole windows of MIN_WORDS words; of the first every second one by its
hash, of the others too, and those in which all short seeds are frequent in the task's group of documents. Seeds with one hash meet in a shard, where up to PAIRS occurrences are all paired up. More of them meet in the document that leads the seed, first within
a task's group of documents and then among these leaders, so a frequent seed makes as many anchors as it has occurrences. Windows of MIN_WORDS
words keep such stars whole: what meets in one is a passage. What a star alone would lose is found by a second path: an occurrence of a frequent short seed that
lies in no passage found so far meets all other occurrences of its seed, in blocks, by the words beside it (`_crossed`), and what can be in a passage with it is aligned too. The anchors of a pair of documents are chained in order of both positions, by a Fenwick tree
over the second position that holds the best score so far, gap costs included. Chains of two anchors or more are aligned on the words
themselves: equal diagonals word by word, small gaps by edit distance, ends by extension. An alignment of MIN_WORDS or
more with a share of equal words of MIN_IDENTITY or more is a passage; of one with too few equal words, the stretches that have enough are.

Documents with the same text are one class; the row with its smallest id stands for it, and every other member has a passage with it that is
the whole document. So every occurrence of a passage is reported with another, and rows do not grow with the square of a group.

Defined cases: a null or empty text, or a short one, has no passages; a null doc_id is left out; rows that share a doc_id and have different texts are documents of
their own, and with the same text are one; repeats inside one document are not reported; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_GAP, documents, materialise
from tidemark.llm.jaccard import _distinct, _grouped, _rows, blobs, mix, shard_of, starts_of

#: The words of a seed in its window. One in five words may differ all along a passage, and some seeds of it are still equal.
SEED = (0, 1, 2, 3, 5, 6)
K = SEED[-1] + 1
FREE = next(k for k in range(K) if k not in SEED)
#: Passages of 50 words count also where edits at their ends shorten the alignment a little.
MIN_WORDS, MIN_IDENTITY = 45, 0.8
MARGIN = 60
#: A seed of up to so many occurrences pairs them all.
PAIRS = 8
GAP_COST = 0.2
#: Words that a passage of MIN_WORDS may differ in, and words that it has beside a seed in it. Of these, one side has half or more; and all lie within FAR words of the other text's seed.
DIFFER = MIN_WORDS - round(MIN_WORDS * MIN_IDENTITY)
BESIDE = MIN_WORDS - K
FAR = BESIDE + DIFFER
#: Up to this distance an occurrence of a seed tells all words between it and the next: text that repeats them is one text, however long.
PERIOD = 4
#: Occurrences of a frequent seed are compared in blocks of at most about so many.
BLOCK = 8192
#: Occurrences, or copies of them for their cells, in a bucket.
CELL_ROWS = 100_000
SHARD_DOCS = 6144
#: Documents and words that a task seeds together, and chains of a document that are cut out together.
CHUNK_DOCS, CHUNK_WORDS, CUTS = 4096, 2_000_000, 256
_ODD = np.array([xxhash.xxh3_64_intdigest(bytes([k, 9])) | 1 for k in range(len(SEED))], np.uint64)
_BASE = np.uint64(xxhash.xxh3_64_intdigest(b"passages") | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_GAP = re.compile(rb"\s")


_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([k, 13])) for k in range(256)], np.uint64)


class Words:
    """Hashes of words, which are remembered: a word is known again by the sum of its bytes' values times powers of a base, taken for all words of a text at once."""

    SLOTS, PIECE = 20, 1 << 20

    def __init__(self):
        self.keys, self.hashes = (np.zeros(1 << self.SLOTS, np.uint64) for _ in range(2))
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.powers, self.inverse = (np.cumprod(np.full(n, x)) for x in (_BASE, _INVERSE))

    def of(self, text: str | None) -> np.ndarray:
        """The words' hashes, lower-cased in A-Z."""
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if len(raw) <= self.PIECE:
            return self._of(raw)
        found, low = [], 0
        while low < len(raw):
            gap = _GAP.search(raw, low + self.PIECE)
            high = gap.start() if gap else len(raw)
            found.append(self._of(raw[low:high]))
            low = high
        return np.concatenate(found)

    def _of(self, raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw, np.uint8)
        if len(data) > len(self.powers):
            self._grow(2 * len(data))
        blank = np.ones(len(data) + 2, bool)
        blank[1:-1] = (data == 32) | (data - np.uint8(9) < 5)
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        begin, end = edges[::2], edges[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.powers[: len(data)], out=total[1:])
        key = (total[end] - total[begin]) * self.inverse[begin]
        slot = (key * _BASE >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.hashes[slot]
        new = np.flatnonzero(self.keys[slot] != key)
        if len(new):
            _, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            once = new[first]
            made = np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(begin[once].tolist(), end[once].tolist(), strict=True)], np.uint64)
            out[new] = made[which]
            _, one = np.unique(slot[once], return_index=True)  # words that share a slot: one stays
            self.keys[slot[once[one]]], self.hashes[slot[once[one]]] = key[once[one]], made[one]
        return out


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions of the seeds of a text of MIN_WORDS words or more, and of the whole windows that are no seeds by themselves. The last bit of a hash tells a whole window from a short one."""
    n = len(words) - K + 1
    h = words[SEED[0] : SEED[0] + n] * _ODD[0]
    for k, odd in zip(SEED[1:], _ODD[1:], strict=True):
        h += words[k : k + n] * odd
    h = mix(h, 3)
    powers, inverse = np.cumprod(np.full(len(words) + 1, _BASE)), np.cumprod(np.full(len(words) + 1, _INVERSE))
    total = np.r_[np.uint64(0), np.cumsum(words * powers[: len(words)])]
    g = mix((total[MIN_WORDS:] - total[:-MIN_WORDS]) * inverse[: len(words) - MIN_WORDS + 1], 4)
    one, two = np.uint64(1), np.uint64(2)
    short, whole, rest = np.flatnonzero((h & two) == 0), np.flatnonzero((g & two) == 0), np.flatnonzero(g & two)
    return np.r_[h[short] & ~one, g[whole] | one], np.r_[short, whole], g[rest] | one, rest


ANCHORS = "bucket int, a binary, b binary, at_a binary, at_b binary"


def _packed_anchors(sig: np.ndarray, who: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, buckets: int) -> list[pa.Array]:
    """Anchors between the occurrences x and y, by bucket of their pair of documents: a, b (a < b), at_a, at_b. A whole window makes one at its begin, in its middle and at its end, near
    enough to each other that they are one chain."""
    swap = who[x] > who[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    far = np.flatnonzero(sig[x] & sig.dtype.type(1))
    a, b = (np.r_[who[k], who[k[far]], who[k[far]]] for k in (x, y))
    at_a, at_b = (np.r_[at[k], at[k[far]] + (MIN_WORDS - K) // 2, at[k[far]] + (MIN_WORDS - K)].astype(np.int32) for k in (x, y))
    bucket = shard_of(mix(mix(a.astype(np.uint64)) ^ b.astype(np.uint64), 5), buckets)
    order = np.argsort(bucket, kind="stable")
    begin = starts_of(bucket[order])
    return [pa.array(bucket[order][begin].astype(np.int32)), *[blobs(v[order], begin) for v in (a, b, at_a, at_b)]]


def _ties(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of occurrences of one seed in two documents, of rows in order of sig, who and position: those of seeds of up to PAIRS occurrences, which all meet, and
    of frequent ones, where each meets one in the document that leads the seed. A document's occurrences meet the leader's in
    order, so that texts of one repeated word line up too. And the mask of the occurrences that are frequent and not the leader's."""
    begin = starts_of(sig)
    width = np.diff(np.r_[begin, len(sig)])
    hot = np.repeat(width > PAIRS, width)
    few = np.flatnonzero(~hot)
    s, w = sig[few], who[few]
    left, right = [], []
    for d in range(1, PAIRS):
        k = np.flatnonzero((s[:-d] == s[d:]) & (w[:-d] != w[d:]))
        left.append(few[k])
        right.append(few[k + d])
    many = np.flatnonzero(hot)
    if len(many):
        s, w = sig[many], who[many]
        new = np.r_[True, s[1:] != s[:-1]]
        own = np.flatnonzero(new | np.r_[True, w[1:] != w[:-1]])
        times = np.diff(np.r_[own, len(s)])
        rank = np.arange(len(s)) - np.repeat(own, times)
        seed = np.cumsum(new)[own] - 1
        order = np.lexsort((w[own], -times, seed))  # the document with most occurrences leads, of equals the smallest
        best = order[np.r_[True, seed[order][1:] != seed[order][:-1]]]
        width = np.diff(np.r_[np.flatnonzero(new), len(s)])
        lead = np.repeat(own[best], width) + np.minimum(rank, np.repeat(times[best], width) - 1)
        other = np.flatnonzero(w != w[lead])
        left.append(many[lead[other]])
        right.append(many[other])
        hot[many] = w != w[lead]
    return np.concatenate(left), np.concatenate(right), hot


def _unseen(hot: np.ndarray, h: np.ndarray, at: np.ndarray, slot: np.ndarray, rest_at: np.ndarray, rest_slot: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The windows of `rest` in which every short seed is hot: what such seeds lead elsewhere, these windows still find."""
    base = np.r_[0, np.cumsum(lengths)]
    short = (h & np.uint64(1)) == 0
    own = short & (hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] != h)
    before = np.r_[0, np.cumsum(np.bincount(base[slot[own]] + at[own], minlength=int(base[-1]) + 1))]
    begin = base[rest_slot] + rest_at
    return np.flatnonzero(before[begin + MIN_WORDS - K + 1] == before[begin])


#: Occurrences of frequent short seeds: the seed (shard and sig), the document, the position.
FREQUENT = "seed binary, who binary, place binary"
SEEDED = f"shard int, ids binary, counts binary, sig binary, at binary, led binary, {ANCHORS}, {FREQUENT}"


def _empty(types: str, n: int) -> list[pa.Array]:
    return [pa.nulls(n, pa.int32() if t.endswith(" int") else pa.binary()) for t in types.split(", ")]


def _seed_keys(shard: np.ndarray | int, sig: np.ndarray) -> np.ndarray:
    return (np.asarray(shard, np.int64) << 32) | sig.astype(np.uint32).astype(np.int64)


def _frequent_rows(seed: np.ndarray, who: np.ndarray, at: np.ndarray) -> Iterator[list[pa.Array]]:
    for k in range(0, len(seed), 100_000):
        yield [pa.array([v[k : k + 100_000].astype(t).tobytes()], pa.binary()) for v, t in ((seed, np.int64), (who, np.int64), (at, np.int32))]


def _seeded(shards: int):
    """Seeds by shard: ids (the documents), counts (their seeds), sig, at, led (the short seeds that lead others of the task's group). And, dealt to shards in turn, anchors of seeds that are frequent in
    the task's group of documents; of those the leader's occurrences alone go on to the shard, the others to the second path."""
    names = [x.split()[0] for x in SEEDED.split(", ")]

    def frequent(h: np.ndarray) -> np.ndarray:
        in_order = np.sort(h)
        return np.unique(in_order[PAIRS:][in_order[PAIRS:] == in_order[:-PAIRS]])

    def flush(ids: list[int], found: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.array(ids, np.int64)
        slot, rest_slot = (np.repeat(np.arange(len(ids)), [len(f[k]) for f in found]) for k in (0, 2))
        lengths = np.array([f[4] for f in found], np.int64)
        h, at, rest, rest_at = (np.concatenate([f[k] for f in found]) for k in range(4))
        led = np.zeros(0, np.uint64)
        hot = frequent(h)
        if len(hot) and len(more := _unseen(hot, h, at, slot, rest_at, rest_slot, lengths)):
            h, at, slot = np.r_[h, rest[more]], np.r_[at, rest_at[more]], np.r_[slot, rest_slot[more]]
            order = np.argsort(slot, kind="stable")
            h, at, slot = h[order], at[order], slot[order]
            hot = frequent(h)
        if len(hot):
            many = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h)
            many = many[np.lexsort((at[many], ids[slot[many]], h[many]))]
            x, y, follows = _ties(h[many], ids[slot[many]])
            anchors = _packed_anchors(h[many], ids[slot[many]], at[many], x, y, shards)
            n = len(anchors[0])
            yield pa.RecordBatch.from_arrays([anchors[0], *[pa.nulls(n, pa.binary())] * 5, *anchors, *_empty(FREQUENT, n)], names)
            led = hot[(hot & np.uint64(1)) == 0]
            short = np.sort(many[follows & ((h[many] & np.uint64(1)) == 0)])
            for k, row in enumerate(_frequent_rows(_seed_keys(shard_of(h[short], shards), h[short]), ids[slot[short]], at[short])):
                turn = pa.array([(int(ids[0]) + k) % shards], pa.int32())
                yield pa.RecordBatch.from_arrays([turn, *[pa.nulls(1, pa.binary())] * 5, turn, *_empty(ANCHORS, 1)[1:], *row], names)
            stays = np.ones(len(h), bool)
            stays[many[follows]] = False
            h, slot, at = h[stays], slot[stays], at[stays]
        shard = shard_of(h, shards)
        order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
        shard, slot, h, at = shard[order], slot[order], h[order], at[order]
        begin = starts_of(shard)
        each = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (slot[1:] != slot[:-1])])
        first = np.searchsorted(each, begin)
        small = at.astype(np.uint16 if at.max() < 1 << 16 else np.uint32)
        none = _empty(f"{ANCHORS}, {FREQUENT}", len(begin))
        of = shard_of(led, shards)
        led = led[np.argsort(of, kind="stable")].astype(np.uint32)
        stops = np.searchsorted(np.sort(of), shard[begin])
        stops = np.r_[stops, len(led)]
        leads = pa.array([led[x:y].tobytes() or None for x, y in zip(stops[:-1], stops[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(shard[begin].astype(np.int32)), blobs(ids[slot[each]], first), blobs(np.diff(np.r_[each, len(h)]).astype(np.uint32), first), blobs(h.astype(np.uint32), begin), blobs(small, begin), leads, *none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, ids, found, held = Words(), [], [], 0
        for i, text in _distinct(batches, "cls"):
            words = make.of(text)
            if len(words) < MIN_WORDS:
                continue
            ids.append(i)
            found.append((*seeds(words), len(words)))
            held += len(words)
            if len(ids) >= CHUNK_DOCS or held >= CHUNK_WORDS:
                yield from flush(ids, found)
                ids, found, held = [], [], 0
        if ids:
            yield from flush(ids, found)

    return run


def _anchors(shards: int):
    """The anchors of a shard's seeds, and those that come with them. And the occurrences of seeds that are frequent here or in a task's group."""
    names = [x.split()[0] for x in f"{ANCHORS}, {FREQUENT}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, lambda r: r["shard"]):
            made = [r for r in rows if r["bucket"] is not None]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in made], pa.int32() if c == "bucket" else pa.binary()) for c in names], names)
            yield from meet([r for r in rows if r["bucket"] is None])

    def meet(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        shard = rows[0]["shard"]
        led = np.unique(np.concatenate([np.frombuffer(r["led"] or b"", np.uint32) for r in rows]))
        sig = np.concatenate([np.frombuffer(r["sig"], np.uint32) for r in rows])
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        begin = starts_of(sig)
        width = np.diff(np.r_[begin, len(sig)])
        several = np.repeat((width > 1) | np.isin(sig[begin], led), width)
        sig, some = sig[several], order[several]
        del order
        who = np.concatenate([np.repeat(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.uint32)) for r in rows])[some]
        at = np.concatenate([np.frombuffer(r["at"], np.uint16 if 2 * len(r["at"]) == len(r["sig"]) else np.uint32).astype(np.uint32) for r in rows])[some].astype(np.int64)
        rows.clear()
        order = np.lexsort((at, who, sig))
        sig, who, at = sig[order], who[order], at[order]
        x, y, _ = _ties(sig, who)
        for k in range(0, len(x), 1_000_000):
            anchors = _packed_anchors(sig, who, at, x[k : k + 1_000_000], y[k : k + 1_000_000], shards)
            yield pa.RecordBatch.from_arrays([*anchors, *_empty(FREQUENT, len(anchors[0]))], names)
        begin = starts_of(sig)
        width = np.diff(np.r_[begin, len(sig)])
        hot = np.flatnonzero(np.repeat((width > PAIRS) | np.isin(sig[begin], led), width) & ((sig & np.uint32(1)) == 0))
        for row in _frequent_rows(_seed_keys(shard, sig[hot]), who[hot], at[hot]):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *_empty(ANCHORS, 1)[1:], *row], names)

    return run


def chain(a: list[int], b: list[int]) -> list[list[int]]:
    """Collinear chains of anchors, given in ascending order of a: lists of anchor numbers, each anchor in one chain at most.

    An anchor adds the words it covers; a gap costs GAP_COST for each word skipped on either side. With
    best[i] = score[i] + GAP_COST * (a[i] + b[i]), the best predecessor is a maximum over smaller b: a prefix of the Fenwick tree.
    """
    ranks = {v: r + 1 for r, v in enumerate(sorted(set(b)))}
    size = len(ranks)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, before = [0.0] * len(a), [-1] * len(a)
    i = 0
    while i < len(a):
        j = i
        while j < len(a) and a[j] == a[i]:  # anchors at one place of a do not follow each other
            best, r = (-1e18, -1), ranks[b[j]] - 1
            while r:
                best = max(best, tree[r])
                r &= r - 1
            gain = best[0] - GAP_COST * (a[j] + b[j]) + 2 * K * GAP_COST
            score[j], before[j] = (K + gain, best[1]) if gain > 0 else (float(K), -1)
            j += 1
        for m in range(i, j):
            entry, r = (score[m] + GAP_COST * (a[m] + b[m]), m), ranks[b[m]]
            while r <= size:
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        i = j
    chains, used = [], [False] * len(a)
    for m in sorted(range(len(a)), key=lambda m: -score[m]):
        links = []
        while m >= 0 and not used[m]:
            used[m] = True
            links.append(m)
            m = before[m]
        if links:
            chains.append(links[::-1])
    return chains


def _thin(pair: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which anchors stay: of each run of neighbours on a diagonal of a pair every K-th and the last."""
    order = np.lexsort((x, y - x, pair))
    p, far, at = pair[order], (y - x)[order], x[order].astype(np.int64)
    head = np.r_[True, (np.diff(p) != 0) | (np.diff(far) != 0) | (np.diff(at) > K)]
    first = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
    step = (at - first) // K
    return np.sort(order[head | np.r_[True, np.diff(step) != 0] | np.r_[head[1:], True]])


CHAINS = "a long, b long, nth int, anchors binary"


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of two anchors or more, and the occurrences of frequent seeds as they come."""
    none, kept = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())], [x.split()[0] for x in FREQUENT.split(", ")]
    names = [*[x.split()[0] for x in CHAINS.split(", ")], *kept]

    def anchors() -> Iterator[pa.RecordBatch]:
        for found in _grouped(batches, lambda r: r["bucket"]):
            for r in found:
                if r["seed"] is not None:
                    yield pa.RecordBatch.from_arrays([*none, *[pa.array([r[c]], pa.binary()) for c in kept]], names)
            for made in _chained([r for r in found if r["seed"] is None], 2):
                yield pa.RecordBatch.from_arrays([*made.columns, *_empty(FREQUENT, made.num_rows)], names)

    return anchors()


def _single_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of two anchors or more, and of one that can be a passage by itself."""
    for found in _grouped(batches, lambda r: r["bucket"]):
        yield from _chained(found, 1)


def _chained(found: list[dict], least: int) -> Iterator[pa.RecordBatch]:
    """a, b, nth and anchors (2 rows of starts) of the chains of `least` anchors or more. A chain of one anchor must be one that can be a passage alone."""
    names, types = [x.split()[0] for x in CHAINS.split(", ")], (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    rows: list[tuple] = []
    if found:
        a, b, x, y = (np.concatenate([np.frombuffer(r[c], t) for r in found]) for c, t in (("a", np.int64), ("b", np.int64), ("at_a", np.int32), ("at_b", np.int32)))
        alone = np.concatenate([np.full(len(r["a"]) // 8, r.get("alone") == b"1") for r in found])
        found.clear()
        order = np.lexsort((y, x, b, a))
        a, b, x, y, alone = a[order], b[order], x[order], y[order], alone[order]
        new = np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)]
        once = new | np.r_[True, (np.diff(x) != 0) | (np.diff(y) != 0)]
        a, b, x, y, alone, new = a[once], b[once], x[once], y[once], alone[once], new[once]
        pair = np.cumsum(new) - 1
        several = (np.bincount(pair)[pair] >= max(2, least)) | ((least == 1) & alone)
        a, b, x, y, alone, pair = a[several], b[several], x[several], y[several], alone[several], pair[several]
        if not len(a):
            return
        keep = _thin(pair, x, y)
        begin = starts_of(pair[keep])
        a, b, x, y, alone = a[keep][begin].tolist(), b[keep][begin].tolist(), x[keep].tolist(), y[keep].tolist(), alone[keep].tolist()
        for i, j, low, high in zip(a, b, begin.tolist(), [*begin[1:].tolist(), len(keep)], strict=True):
            for nth, links in enumerate(chain(x[low:high], y[low:high])):
                if len(links) >= least and (len(links) > 1 or alone[low + links[0]]):
                    rows.append((i, j, nth, np.array([[x[low + m] for m in links], [y[low + m] for m in links]], np.int32).tobytes()))
            if len(rows) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _beside(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each occurrence the FAR words after it and the FAR words before it, nearest first, as bytes from 1; 0 where the text has ended."""
    none = np.zeros(FAR, np.uint8)
    small = np.r_[none, ((words >> np.uint64(56)) % np.uint64(255) + np.uint64(1)).astype(np.uint8), none]
    step = np.arange(FAR)
    return np.concatenate([small[FAR + at[:, None] + K + step], small[FAR + at[:, None] - 1 - step]], axis=1)


def _counted(side: np.ndarray) -> np.ndarray:
    """The bytes of one side, a row for each distance. A word that comes again is another one, so that what is shared counts as often as both have it."""
    times = np.zeros(side.shape, np.int16)
    for k in range(1, len(side)):
        times[k:] += side[k:] == side[:-k]
    return np.where(side > 0, (side + 101 * times) % 255 + 1, 0).astype(np.uint8)


def _steps(seed: np.ndarray, at: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """How far before each occurrence the same seed stands in the text, up to K, else 0. Two occurrences of one step lie on the diagonal of those before them, which meet for them."""
    order = np.lexsort((at, asks, seed))
    far = np.diff(at[order])
    same = (seed[order][1:] == seed[order][:-1]) & (asks[order][1:] == asks[order][:-1]) & (far > 0) & (far <= K)
    out = np.zeros(len(at), np.uint8)
    out[order[1:]] = np.where(same, far, 0)
    return out


def _copies(words: np.ndarray, seed: np.ndarray, at: np.ndarray, beside: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a document's occurrences those that answer and those that may ask. Where a window inside a run has the same FAR words on both sides again, it is a copy: the first one answers for all. Of the copies that lie
    within BESIDE positions the first and the last ask, whose passages, MIN_WORDS or more, cover what lies between."""
    if not ((steps > 0) & (steps <= PERIOD)).any():
        return np.ones(len(at), bool), np.ones(len(at), bool)
    text = np.concatenate([beside, np.zeros((len(at), -2 * FAR % 8), np.uint8)], axis=1).view(np.uint64)
    key = mix(seed.astype(np.uint64), 10) ^ words[at + FREE]
    for k in range(text.shape[1]):
        key = mix(key ^ text[:, k], 11)
    order = np.lexsort((at, key))
    new = np.r_[True, key[order][1:] != key[order][:-1]] | (steps[order] == 0) | (steps[order] > PERIOD)
    part = new | np.r_[True, np.diff(at[order] // BESIDE) != 0]
    answers, asks = (np.zeros(len(at), bool) for _ in range(2))
    answers[order[new]] = True
    asks[order[part | np.r_[part[1:], True]]] = True
    return answers, asks


CROSSED = "bucket int, cell binary, who binary, place binary, role binary, beside binary"


def _dealt(buckets: int):
    """The frequent seeds' occurrences with the words beside them, by bucket of their cells: a cell is a seed and two of its blocks. An occurrence asks (role 1) in the cells of its block's row and
    answers (role 2) in those of its column; a seed of one block has one cell. The role's higher bits hold the step."""
    names = [x.split()[0] for x in CROSSED.split(", ")]

    def flush(held: list[tuple]) -> pa.RecordBatch:
        seed, cls, at, asks, answers, blocks, beside, steps = (np.concatenate([h[k] for h in held]) for k in range(8))
        own = (mix(cls.astype(np.uint64), 6) % blocks.astype(np.uint64)).astype(np.int64)
        parts = []
        one = np.flatnonzero(blocks == 1)
        parts.append((one, own[one], own[one], asks[one] + 2 * answers[one]))
        for role, some in ((1, np.flatnonzero((blocks > 1) & asks)), (2, np.flatnonzero((blocks > 1) & answers))):
            times = blocks[some]
            each = np.repeat(some, times)
            other = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            parts.append((each, own[each] if role == 1 else other, other if role == 1 else own[each], np.full(len(each), role)))
        row, i, j, role = (np.concatenate([p[k] for p in parts]) for k in range(4))
        cell = mix(mix(mix(seed[row].astype(np.uint64), 7) ^ i.astype(np.uint64), 8) ^ j.astype(np.uint64), 9)
        bucket = shard_of(cell, buckets)
        order = np.argsort(bucket, kind="stable")
        begin = starts_of(bucket[order])
        row = row[order]
        sides = pa.array([beside[row[x:y]].tobytes() for x, y in zip(begin, np.r_[begin[1:], len(row)], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][begin].astype(np.int32)), blobs(cell[order], begin), blobs(cls[row], begin), blobs(at[row].astype(np.int32), begin), blobs((role[order] + 4 * steps[row]).astype(np.uint8), begin), sides], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held, size = Words(), [], 0
        for batch in batches:
            spots, texts = batch.column("spots"), batch.column("text")
            for k, cls in enumerate(batch.column("cls").to_pylist()):
                flat = spots[k].values
                seed, at, blocks = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seed", "at", "blocks"))
                is_open = flat.field("open").to_numpy(zero_copy_only=False).astype(bool)
                words = make.of(texts[k].as_py())
                beside, steps = _beside(words, at), _steps(seed, at, is_open)
                answers, asks = _copies(words, seed, at, beside, steps)
                asks &= is_open
                some = np.flatnonzero(answers | asks)
                held.append(tuple(v[some] for v in (seed, np.full(len(seed), cls, np.int64), at, asks, answers, blocks, beside, steps)))
                size += int(np.where(blocks > 1, 2 * blocks, 1)[some].sum())
                if size >= 500_000:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _sets(side: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """The nearest bytes of one side, so many each, as sets of 256 bits."""
    bits, out = np.zeros((4, side.shape[1]), np.uint64), {}
    for k, v in enumerate(side):
        bit = np.where(v > 0, np.uint64(1) << (v & np.uint8(63)).astype(np.uint64), np.uint64(0))
        for word in range(4):
            bits[word] |= np.where(v >> 6 == word, bit, np.uint64(0))
        if k + 1 in widths:
            out[k + 1] = bits.copy()
    return out


def _missing(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many of the nearest 0, 1, ... BESIDE words of one side are not among the other's, DIFFER words further at most; a row for each distance. Where a text has ended, too many."""
    gone = np.zeros((BESIDE + 1, own.shape[1]), np.int16)
    for k in range(BESIDE):
        gone[k + 1] = np.where(own[k] == 0, DIFFER + 1, ~(other[: k + 1 + DIFFER] == own[k]).any(axis=0))
    return np.cumsum(gone, axis=0, dtype=np.int16)


def _reach(own: np.ndarray, other: np.ndarray, start: int) -> np.ndarray:
    """How far `_extend` goes at most from `start` equal words, by the bytes of one side; where it goes on beyond them, MIN_WORDS."""
    total = 2 * start + np.cumsum(np.where((own == other) & (own > 0), 2, -3).astype(np.int16), axis=1, dtype=np.int16)
    ended = np.maximum.accumulate(np.maximum(total, 2 * start), axis=1) - total > 16
    total[np.maximum.accumulate(ended, axis=1)] = -1
    steps = np.where(total.max(axis=1) > 2 * start, start + 1 + total.argmax(axis=1), start)
    return np.where(ended.any(axis=1), steps, MIN_WORDS)


class _Beside:
    """The words beside a bucket's occurrences. Compared are the nearer half of a side (or three quarters, if the other side is too short for the rest), then a quarter, half and three quarters of both, as sets of bits, which lose nothing, then all by their bytes. The sets count words that repeat; the bytes, held to DIFFER words of their place, don't, as one that comes again may be equal where the first is changed."""

    QUARTER, HALF, MOST = BESIDE // 4 + 1, BESIDE // 2, 3 * BESIDE // 4 + 1
    # the other side of a half has a quarter's words at least, or the side itself has three quarters
    assert HALF + QUARTER <= MOST and BESIDE - MOST + 1 >= QUARTER
    #: Of the words beside a seed so many are equal at their places at least, if its own diagonal can be a passage: an equal word adds 1 to the score of a side, which is above 0, and another takes 1.5.
    EQUAL = 3 * BESIDE // 5

    def __init__(self, beside: np.ndarray):
        self.plain = beside
        n, widths = len(beside), (self.QUARTER, self.HALF, self.MOST)
        self.has, self.lacks, self.far_lacks, self.short = np.empty((n, 2, 3, 4), np.uint64), np.empty((n, 2, 3, 4), np.uint64), np.empty((n, 2, 1, 2), np.uint64), []
        for k in (0, 1):
            side = _counted(np.ascontiguousarray(beside[:, k * FAR : (k + 1) * FAR].T))
            sets = _sets(side, [*widths, *(w + DIFFER for w in widths), FAR])
            for j, w in enumerate(widths):
                self.has[:, k, j] = np.where(side[w - 1] == 0, ~np.uint64(0), sets[w]).T  # all, where there are too few words on this side
                self.lacks[:, k, j] = ~sets[w + DIFFER].T
            self.far_lacks[:, k, 0] = ~self._folded(sets[FAR].T)
            self.short.append(side[self.QUARTER - 1] == 0)
        self.has_folded = self._folded(self.has)
        self.near_lacks = [[np.ascontiguousarray(~self._folded(~self.lacks[:, k, j]).T) for j in range(3)] for k in (0, 1)]

    @staticmethod
    def _folded(sets: np.ndarray) -> np.ndarray:
        """Sets of 128 bits."""
        return sets[..., :2] | sets[..., 2:]

    def near(self, asking: np.ndarray, answering: np.ndarray, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in `asking` and in `answering` of rows whose nearer words of a side allow a passage. Two that ask meet twice, as what one lacks of the other is not what the other lacks of it."""
        short = [s[asking] for s in self.short]
        for some, tests in ((~short[0] & ~short[1], ((0, 1), (1, 1))), (short[0] & ~short[1], ((1, 2),)), (short[1] & ~short[0], ((0, 2),))):
            some = np.flatnonzero(some)
            if len(some):
                for x, y in self._near(asking[some], answering, tests, step):
                    yield some[x], y

    def _near(self, asking: np.ndarray, answering: np.ndarray, tests: tuple, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sides = [(self.has_folded[asking, k, j], self.near_lacks[k][j][:, answering]) for k, j in tests]
        n = len(answering)
        rows = min(len(asking), max(1, step // n))
        bits, few, more, may, hit = (np.zeros((rows, n), t) for t in (np.uint64, np.uint8, np.uint8, bool, bool))
        for first in range(0, len(asking), rows):
            part = slice(0, min(rows, len(asking) - first))
            for (own, lacks), out in zip(sides, (may, hit), strict=False):
                for word, count in ((0, few), (1, more)):
                    np.bitwise_and(own[first : first + rows, word, None], lacks[word], out=bits[part])
                    np.bitwise_count(bits[part], out=count[part])
                np.add(few[part], more[part], out=few[part])
                np.less_equal(few[part], DIFFER, out=out[part])
            found = np.flatnonzero(may[part] | hit[part])
            x = found // n
            yield x + first, found - x * n

    @staticmethod
    def _allow(lost: np.ndarray) -> np.ndarray:
        """By the words of a quarter, half and three quarters of both sides that are not beside the other."""
        quarter, half, most = (lost[:, :, j] for j in range(3))
        return (np.minimum(most[:, 0], most[:, 1]) <= DIFFER) | (np.minimum(half[:, 0] + quarter[:, 1], half[:, 1] + quarter[:, 0]) <= DIFFER)

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of rows the words beside them allow a passage: of some BESIDE words around the seed all but DIFFER stand beside the other's, or the diagonal goes on where these differ more."""
        out, step = [np.zeros(0, np.int64)], 8192
        for k in range(0, len(x), step):
            lost = np.bitwise_count(self.has_folded[x[k : k + step]] & self.far_lacks[y[k : k + step]])
            out.append(k + np.flatnonzero(self._allow(lost[..., 0] + lost[..., 1])))
        some, out = np.concatenate(out), [np.zeros(0, np.int64)]
        for k in range(0, len(some), step):
            p = some[k : k + step]
            fits = self._allow(np.bitwise_count(self.has[x[p]] & self.lacks[y[p]]).sum(axis=3, dtype=np.uint8))
            q = np.flatnonzero(fits)
            own, other = (np.ascontiguousarray(self.plain[v[p[q]]].T) for v in (x, y))
            right, left = (_missing(own[low : low + FAR], other[low : low + FAR]) for low in (0, FAR))
            fits[q] = (right + left[::-1]).min(axis=0) <= DIFFER
            own, other = self.plain[x[p]], self.plain[y[p]]
            q = np.flatnonzero(~fits & (((own == other) & (own > 0)).sum(axis=1, dtype=np.uint8) >= self.EQUAL))
            fits[q] = self.alone(x[p[q]], y[p[q]])
            out.append(p[fits])
        return np.concatenate(out)

    def alone(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of rows can be a passage by their own diagonal, as a chain of one anchor is aligned."""
        out = [np.zeros(0, bool)]
        for k in range(0, len(x), 20_000):
            p, q = self.plain[x[k : k + 20_000]], self.plain[y[k : k + 20_000]]
            out.append(_reach(p[:, :FAR], q[:, :FAR], K) + _reach(p[:, FAR:], q[:, FAR:], 0) >= MIN_WORDS)
        return np.concatenate(out)


#: Anchors of the second path say whether a chain of the anchor alone can be a passage.
SINGLE = f"{ANCHORS}, alone binary"


def _crossed(shards: int):
    """Anchors between the occurrences that ask and those that answer in a cell, in two documents, where the words beside them are alike."""
    names = [x.split()[0] for x in SINGLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, lambda r: r["bucket"]):
            cell, who, at, role, beside = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("cell", np.uint64), ("who", np.int64), ("place", np.int32), ("role", np.uint8), ("beside", np.uint8)))
            rows.clear()
            beside, role, steps = _Beside(beside.reshape(-1, 2 * FAR)), role & 3, role >> 2
            order = np.argsort(cell, kind="stable")
            begin = starts_of(cell[order])
            held, size = [], 0
            for low, high in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
                mine = order[low:high]
                asking, answering = mine[role[mine] & 1 > 0], mine[role[mine] & 2 > 0]
                if not len(asking) or not len(answering):
                    continue
                for x, y in beside.near(asking, answering):
                    x, y = asking[x], answering[y]
                    other = (who[x] != who[y]) & ((steps[x] == 0) | (steps[x] != steps[y]))
                    held.append((x[other], y[other]))
                    size += len(held[-1][0])
                    if size >= 200_000:
                        yield from anchors(beside, who, at, held)
                        held, size = [], 0
            if size:
                yield from anchors(beside, who, at, held)

    def anchors(beside: _Beside, who: np.ndarray, at: np.ndarray, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        x, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        fits = beside.alike(x, y)
        x, y = x[fits], y[fits]
        if len(x):
            alone = beside.alone(x, y)
            for flag in (False, True):
                some = np.flatnonzero(alone == flag)
                if len(some):
                    made = _packed_anchors(np.zeros(len(who), np.uint64), who, at.astype(np.int64), x[some], y[some], shards)
                    yield pa.RecordBatch.from_arrays([*made, pa.array([b"1" if flag else b"0"] * len(made[0]), pa.binary())], names)

    return run


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each occurrence of a frequent seed."""
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], t)) for c, t in (("seed", np.int64), ("who", np.int64), ("place", np.int32))], ["seed", "cls", "at"])


def _open_seeds(spots: DataFrame) -> DataFrame:
    """Seeds that have an open occurrence and stand in several documents."""
    counted = spots.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.bool_or("open").alias("any"), (F.min("cls") != F.max("cls")).alias("several"))
    return counted.where("any AND several").select("seed", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"), "n")


def _without_long_runs(spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The occurrences of open seeds (seed, cls, at, open), those in long runs no longer open, and chains that make passages of these runs.

    A run is a stretch in which a seed comes again after one to PERIOD words each time. All runs of a seed and distance are one text, of different lengths: each one of MIN_WORDS or more is laid against the longest,
    which is laid against the longest of another document, piece by piece. So rows grow with the length of runs, not with their lengths times the documents that have them."""
    spots = spots.join(_open_seeds(spots).select("seed"), "seed", "left_semi")
    w = Window.partitionBy("seed", "cls").orderBy("at")
    steps = spots.withColumn("step", F.col("at") - F.lag("at").over(w)).withColumn("before", F.lag("step").over(w))
    begins = F.when((F.col("step") <= PERIOD) & (F.col("step") > 0) & (F.coalesce("before", F.lit(99)) > PERIOD), 0).when((F.col("step") == F.col("before")) & (F.col("step") <= PERIOD), 0).otherwise(1)
    numbered = steps.withColumn("run", F.sum(begins).over(w))
    runs = numbered.groupBy("seed", "cls", "run").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("n"), F.bool_or("open").alias("open"))
    runs = runs.where(F.col("high") - F.col("low") + K >= MIN_WORDS).select("seed", "cls", "low", "high", "open", ((F.col("high") - F.col("low")) / (F.col("n") - 1)).cast("int").alias("step"))
    runs = materialise(runs)
    longest = F.max(F.struct((F.col("high") - F.col("low")).alias("span"), "cls", "low", "high"))
    first = runs.groupBy("seed", "step").agg(longest.alias("first"))
    others = runs.join(first, ["seed", "step"]).where("cls <> first.cls").groupBy("seed", "step").agg(F.max("first").alias("first"), longest.alias("second"))
    runs = runs.join(others, ["seed", "step"]).withColumn("other", F.when(F.expr("cls = first.cls"), F.col("second")).otherwise(F.col("first")))
    runs = materialise(runs.select("seed", "cls", "low", "high", "open", "step", F.col("other.cls").alias("other"), F.col("other.low").alias("other_low"), F.col("other.high").alias("other_high")))
    inside = runs.groupBy("seed", "cls").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    lies_in = F.exists("runs", lambda r: (r["low"] <= F.col("at")) & (F.col("at") <= r["high"]))
    spots = spots.join(inside, ["seed", "cls"], "left").select("seed", "cls", "at", (F.col("open") & ~F.coalesce(lies_in, F.lit(False))).alias("open"))
    return materialise(spots), materialise(runs.where("open").mapInArrow(_tiles, CHAINS))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of one anchor that lay the other run against a run, piece by piece; their numbers are below those of other chains."""
    names, types = [x.split()[0] for x in CHAINS.split(", ")], (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            step, low, high, begin, end = r["step"], r["low"], r["high"], r["other_low"], r["other_high"]
            left = min((end - begin) // 2, MARGIN) // step * step
            right = min(end - begin - left, MARGIN)
            every = max(step, (left + right) // step * step)
            spots = [(at, begin + left) for at in range(low + left, high + 1, every) if left + min(right, high - at) + K >= MIN_WORDS]
            if not spots or spots[-1][0] + right < high:
                spots.append((high, end))
            for mine, its in spots:
                pair, at = ((r["cls"], r["other"]), (mine, its)) if r["cls"] < r["other"] else ((r["other"], r["cls"]), (its, mine))
                rows.append((*pair, -2 * mine - 1 - (r["cls"] < r["other"]), np.array([[at[0]], [at[1]]], np.int32).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


SLICES = "a long, b long, nth int, side int, doc_id long, low int, words binary, anchors binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of one side of each chain that a document's row asks for, MARGIN words around it included."""
    make = Words()
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in SLICES.split(", ")]
    for batch in batches:
        for i, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("wanted"), strict=True):
            words = make.of(text.as_py()).astype(np.uint32)
            rows = []
            for a, b, nth, side, anchors in zip(*(wanted.values.field(c).to_pylist() for c in ("a", "b", "nth", "side", "anchors")), strict=True):
                starts = np.frombuffer(anchors, np.int32)
                first, last = (0, len(starts) // 2 - 1) if side == 0 else (len(starts) // 2, -1)
                low = max(0, int(starts[first]) - MARGIN)
                rows.append((a, b, nth, side, i, low, words[low : int(starts[last]) + K + MARGIN].tobytes(), anchors if side == 0 else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How far two sequences go on together: steps and equal words at the best score (equal 1, unequal -1.5), stopping 8 below it."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    same = x[:n] == y[:n]
    total = np.cumsum(np.where(same, 1.0, -1.5))
    drop = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > 8)
    total = total[: drop[0]] if len(drop) else total
    if not len(total) or total.max() <= 0:
        return 0, 0
    steps = int(total.argmax()) + 1
    return steps, int(same[:steps].sum())


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Longest common subsequence of two short pieces."""
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        row = np.maximum.accumulate(np.maximum(row, np.r_[0, row[:-1] + (y == w)]))
    return int(row[-1])


def align(x: np.ndarray, y: np.ndarray, anchors: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """Begin and end in x and in y, aligned words, equal words. anchors: 2 rows of starts of equal K-word windows, ascending."""
    at_x, at_y = int(anchors[0, 0]), int(anchors[1, 0])
    steps, same = _extend(x[:at_x][::-1], y[:at_y][::-1])
    begin_x, begin_y, length, equal = at_x - steps, at_y - steps, steps, same
    for next_x, next_y in anchors.T[1:].tolist():
        dx, dy = next_x - at_x, next_y - at_y
        if dx == dy:
            equal += int((x[at_x:next_x] == y[at_y:next_y]).sum())
        else:
            equal += _common(x[at_x:next_x], y[at_y:next_y])
        length += max(dx, dy)
        at_x, at_y = next_x, next_y
    steps, same = _extend(x[at_x:], y[at_y:])
    return begin_x, at_x + steps, begin_y, at_y + steps, length + steps, equal + same


def _longest(score: list[int], length: list[int], low: int, high: int) -> tuple[int, int]:
    """Of the stretches whose score does not fall, the longest: where it begins and ends."""
    falls = [low]
    for k in range(low + 1, high + 1):
        if score[k] < score[falls[-1]]:
            falls.append(k)
    best = (low, low)
    for k in range(high, low, -1):
        while falls and score[falls[-1]] <= score[k]:
            m = falls.pop()
            if length[k] - length[m] > length[best[1]] - length[best[0]]:
                best = (m, k)
        if not falls:
            break
    return best


def stretches(x: np.ndarray, y: np.ndarray, anchors: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Like align, and if the whole has too few equal words, its stretches that have enough, longest first."""
    whole = x0, x1, y0, y1, words, equal = align(x, y, anchors)
    if min(x1 - x0, y1 - y0) < MIN_WORDS or equal >= MIN_IDENTITY * words:
        return [whole]
    stops = [(x0, y0), *anchors.T.tolist(), (x1, y1)]
    parts = []
    for (u, v), (next_u, next_v) in zip(stops[:-1], stops[1:], strict=True):
        if next_u - u == next_v - v:
            n = np.arange(next_u - u)
            parts.append(np.stack([u + n + 1, v + n + 1, n * 0 + 1, x[u:next_u] == y[v:next_v]]))
        else:
            parts.append(np.array([[next_u], [next_v], [max(next_u - u, next_v - v)], [_common(x[u:next_u], y[v:next_v])]]))
    steps = np.concatenate(parts, axis=1)
    at_x, at_y = np.r_[x0, steps[0]], np.r_[y0, steps[1]]
    long, same = np.r_[0, np.cumsum(steps[2])], np.r_[0, np.cumsum(steps[3])]
    score, length = np.round(100 * same - 100 * MIN_IDENTITY * long).astype(np.int64).tolist(), long.tolist()
    out, todo = [], [(0, len(score) - 1)]
    while todo:
        low, high = todo.pop()
        if length[high] - length[low] < MIN_WORDS:
            continue
        m, k = _longest(score, length, low, high)
        if length[k] - length[m] >= MIN_WORDS:
            out.append((int(at_x[m]), int(at_x[k]), int(at_y[m]), int(at_y[k]), int(long[k] - long[m]), int(same[k] - same[m])))
            todo += [(low, m), (k, high)]
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of the chains whose two sides come one after the other. Rows that repeat make the sides come more than once: the first ones count."""
    names = ["doc_id", "start", "end", "first_doc_id", "first_start", "first_end", "words", "identity", "a", "b"]
    types = [*[pa.int64()] * 7, pa.float64(), pa.int64(), pa.int64()]
    rows: list[tuple] = []
    for sides in _grouped(batches, lambda r: (r["a"], r["b"], r["nth"])):
        one, two = sides[0], next(r for r in sides if r["side"])
        anchors = np.frombuffer(one["anchors"], np.int32).reshape(2, -1) - np.array([[one["low"]], [two["low"]]], np.int32)
        for x0, x1, y0, y1, length, equal in stretches(np.frombuffer(one["words"], np.uint32), np.frombuffer(two["words"], np.uint32), anchors):
            if min(x1 - x0, y1 - y0) >= MIN_WORDS and equal >= MIN_IDENTITY * length:
                rows.append((two["doc_id"], y0 + two["low"], y1 + two["low"], one["doc_id"], x0 + one["low"], x1 + one["low"], length, equal / length, one["a"], one["b"]))
        if len(rows) > 4000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (in words), first_doc_id, first_start, first_end, words, identity: a passage of a document, and where one before it has it."""
    keyed = _rows(docs).where(f"doc_id IS NOT NULL AND length(text) >= {2 * MIN_WORDS - 1}")
    sizes = materialise(keyed.select("doc_id", "th", F.unhex(F.md5("text")).alias("key"), F.length("text").alias("n_chars")))
    firsts = sizes.groupBy("key", "n_chars").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = materialise(firsts.orderBy("first", "key").select(F.monotonically_increasing_id().alias("cls"), "key", "n_chars", "rows", "first.doc_id", "first.th"))
    shards = max(1, -(-classes.count() // SHARD_DOCS))

    def texts(of: DataFrame) -> DataFrame:
        return _rows(docs).join(of.select("cls", "doc_id", "th").hint("merge"), ["doc_id", "th"]).select("cls", "text")

    seeded = texts(classes).mapInArrow(_seeded(shards), SEEDED)
    anchors = seeded.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(_anchors(shards), f"{ANCHORS}, {FREQUENT}")
    pairs = anchors.repartitionById(shards, "bucket").sortWithinPartitions("bucket")
    chains = materialise(pairs.mapInArrow(_chains, f"{CHAINS}, {FREQUENT}"))

    def aligned(chains: DataFrame) -> DataFrame:
        asked = chains.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cls"), F.lit(1).alias("side")))).alias("s"), "a", "b", "nth", "anchors")
        asked = asked.select("s.cls", "s.side", "a", "b", "nth", "anchors")
        busy = materialise(asked.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / F.lit(CUTS)).alias("parts")).where("parts > 1"))
        dealt = asked.join(busy, "cls", "left").withColumn("part", F.pmod(F.xxhash64("a", "b", "nth"), F.coalesce("parts", F.lit(1))))
        wanted = dealt.groupBy("cls", "part").agg(F.collect_list(F.struct("a", "b", "nth", "side", "anchors")).alias("wanted"))
        wanted = wanted.join(classes.select("cls", "doc_id", "th"), "cls").select("doc_id", "th", "wanted")
        sides = _rows(docs).join(wanted.hint("merge"), ["doc_id", "th"]).select("doc_id", "text", "wanted").mapInArrow(_slices, SLICES)
        found = sides.repartition("a", "b", "nth").sortWithinPartitions("a", "b", "nth", "side")
        types = "doc_id long, start long, end long, first_doc_id long, first_start long, first_end long, words long, identity double, a long, b long"
        return materialise(found.mapInArrow(_aligned, types).distinct())

    passages = aligned(chains.where("anchors IS NOT NULL").select("a", "b", "nth", "anchors"))
    # The second path: what stars of frequent seeds have left open.
    covers = passages.select(F.explode(F.array(F.struct(F.col("b").alias("cls"), "start", "end"), F.struct(F.col("a").alias("cls"), F.col("first_start").alias("start"), F.col("first_end").alias("end")))).alias("c"))
    covers = covers.groupBy("c.cls").agg(F.collect_set(F.struct("c.start", "c.end")).alias("covers"))
    spots = chains.where("seed IS NOT NULL").select("seed", "who", "place").mapInArrow(_spots, "seed long, cls long, at int")
    lies_in = F.exists("covers", lambda c: (c["start"] <= F.col("at")) & (F.col("at") + K <= c["end"]))
    spots = materialise(spots.join(covers, "cls", "left").select("seed", "cls", "at", (~F.coalesce(lies_in, F.lit(False))).alias("open")))
    spots, tiles = _without_long_runs(spots)
    passages = passages.unionByName(aligned(tiles))
    open_seeds = materialise(_open_seeds(spots))
    total = open_seeds.agg(F.sum(F.expr("CASE WHEN blocks > 1 THEN 2 * n * blocks ELSE n END"))).first()[0]
    if total:
        buckets = -(-int(total) // CELL_ROWS)
        of = spots.join(open_seeds.select("seed", "blocks"), "seed").groupBy("cls").agg(F.collect_list(F.struct("seed", "at", "blocks", "open")).alias("spots"))
        of = of.join(classes.select("cls", "doc_id", "th"), "cls")
        beside = _rows(docs).join(of.hint("merge"), ["doc_id", "th"]).select("cls", "text", "spots").mapInArrow(_dealt(buckets), CROSSED)
        crossed = beside.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_crossed(shards), SINGLE)
        pairs = crossed.repartitionById(shards, "bucket").sortWithinPartitions("bucket")
        passages = passages.unionByName(aligned(materialise(pairs.mapInArrow(_single_chains, CHAINS))))
    passages = passages.drop("a", "b").distinct()
    zero = F.lit(0).cast("long")
    several = classes.where("rows > 1")
    words = F.size(F.filter(F.split("text", WORD_GAP), lambda w: w != "")).cast("long")
    long = texts(several).select("cls", words.alias("n_words")).where(f"n_words >= {MIN_WORDS}").distinct()
    reps = several.join(long, "cls").select("key", "n_chars", "n_words", F.col("doc_id").alias("rep"))
    copies = sizes.join(materialise(reps).hint("merge"), ["key", "n_chars"]).where("doc_id <> rep").select("doc_id", "n_words", "rep").distinct()
    copies = copies.select("doc_id", zero.alias("start"), F.col("n_words").alias("end"), F.col("rep").alias("first_doc_id"), zero.alias("first_start"), F.col("n_words").alias("first_end"), F.col("n_words").alias("words"), F.lit(1.0).alias("identity"))
    return passages.unionByName(copies)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
