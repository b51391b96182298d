"""Lexical retrieval packing.

Texts are tokenized once, and dealt to shards by content: a document's key is its first term in a random order that favours rare terms (a min-hash weighted by
inverse document frequency), then its second and third, and shards are cut from the documents in the order of their keys, a key of very many documents into several. So
documents that share their telling terms often share a shard. The order, and how much room a first term gets, are counted over all documents: the ids are written once and read again for that. Each shard holds its documents' tokens in a BM25 inverted index, with
the document frequencies and the mean length of all pieces of all documents.
The longest unused piece seeds a window; the index returns its unused neighbours by score, and they fill the window
greedily, whole if they fit. When none fits, the best neighbour is cut to fill the window exactly, and its rest stays
in the shard as a piece of its own. So a shard pads its last window and what is less than MIN_CUT elsewhere.

Defined cases: a null text is empty; every document, also an empty one, ends in one END id; documents longer than a
window are cut; rows that repeat a doc_id are packed one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, lean, materialise
from tidemark.llm.jaccard import mix
from tidemark.llm.tokens import WordTokens

WINDOW = 2048
END = 1
MIN_CUT = 8
SHARD_ROWS = 1536
#: A shard of very long documents, or of more rows than this share of its own, is packed in parts of about so many tokens.
SHARD_TOKENS, SHARD_EXCESS = 6_000_000, 4
#: The part of a first term's shards over which documents of one key are spread.
SPREAD = 0.3
#: Neighbours that are sorted before the others.
BEST = 64
#: Rows that a task holds as Python objects at a time.
STEP = 2000
K1, BM25_B = 1.2, 0.75
#: A term of more than this share of a shard's pieces has a row in the dense table.
DENSE_SHARE = 0.08
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Statistics:
    """Of all pieces: how many there are, their mean length, and how many hold each term."""

    pieces: int
    mean: float
    df: np.ndarray

    @classmethod
    def of(cls, pieces: list[np.ndarray]) -> Statistics:
        df = np.bincount(np.concatenate([np.unique(p) for p in pieces]).astype(np.int64)) if pieces else np.zeros(0, np.int64)
        return cls(len(pieces), float(np.mean([len(p) for p in pieces])) if pieces else 0.0, df)

    @property
    def idf(self) -> np.ndarray:
        return np.log(1 + (self.pieces - self.df + 0.5) / (self.df + 0.5))


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order and how often each occurs."""
    x = np.sort(ids, kind="stable")
    new = np.ones(len(x) + 1, bool)
    np.not_equal(x[1:], x[:-1], out=new[1:-1]) if len(x) else None
    at = np.flatnonzero(new) if len(x) else np.zeros(1, np.int64)
    return x[at[:-1]], np.diff(at)


class InvertedIndex:
    """BM25 over the pieces of a shard: postings by term, each with its finished weight. Terms of many pieces stand in a dense table instead."""

    def __init__(self, pieces: list[np.ndarray], statistics: Statistics | None = None):
        size = np.array([len(p) for p in pieces], np.float64)
        terms, counts = zip(*map(counted, pieces), strict=True)
        owner = np.repeat(np.arange(len(pieces)), [len(t) for t in terms])
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float64)
        df = np.bincount(term)
        statistics = statistics or Statistics(len(pieces), size.mean(), df)
        idf = statistics.idf
        norm = K1 * (1 - BM25_B + BM25_B * size / max(statistics.mean, 1))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[owner])
        common = np.flatnonzero(df > DENSE_SHARE * len(pieces))
        self.column = np.full(len(df), -1)
        self.column[common] = np.arange(len(common))
        dense = self.column[term] >= 0
        self.table = np.zeros((len(common), len(pieces)), np.float32)
        self.table[self.column[term[dense]], owner[dense]] = weight[dense]
        self.terms = terms
        order = np.argsort(term[~dense], kind="stable")
        self.owner, self.weight = owner[~dense][order], weight[~dense][order]
        self.at = np.r_[0, np.cumsum(np.where(self.column < 0, df, 0))]
        self.pieces = len(pieces)

    def scores(self, piece: int) -> np.ndarray:
        """BM25 of every piece of the shard for the terms of this one."""
        terms = self.terms[piece].astype(np.int64)
        column = self.column[terms]
        rare = terms[column < 0]
        begin, end = self.at[rare], self.at[rare + 1]
        length = end - begin
        spots = np.arange(length.sum()) + np.repeat(begin - np.cumsum(length) + length, length)
        return np.bincount(self.owner[spots], self.weight[spots], minlength=self.pieces) + self.table[column[column >= 0]].sum(axis=0)


def _split(score: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BEST pieces in order of their score, and the others."""
    part, n = near, len(near)
    if n > 2 * BEST:
        place = np.argpartition(score[near], n - BEST)
        part, others = np.sort(near[place[-BEST:]]), np.sort(near[place[:-BEST]])
    else:
        others = near[:0]
    return part[np.argsort(-score[part], kind="stable")], others


def pack(lengths: list[int], tokens: list[np.ndarray], window: int = WINDOW, statistics: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length)."""
    full = [(d, s) for d, n in enumerate(lengths) for s in range(0, n - window + 1, window)]
    out = [[(d, s, window)] for d, s in full]
    rest = [(d, n - n % window, n % window) for d, n in enumerate(lengths) if n % window]
    if not rest:
        return out
    doc, start, left = (np.array(x, np.int64) for x in zip(*rest, strict=True))
    index = InvertedIndex([tokens[d][s : s + n] for d, s, n in rest], statistics)
    for seed in np.argsort(-left, kind="stable"):
        if not left[seed]:
            continue
        room = window - int(left[seed])
        sequence = [(int(doc[seed]), int(start[seed]), int(left[seed]))]
        left[seed] = 0
        if room:
            score = index.scores(int(seed))
            near = np.flatnonzero(left)
            best, others = _split(score, near)
            for some in (best, others):
                if some is others:  # of these only what fits is put in order
                    some = others[left[others] <= room]
                    some = some[np.argsort(-score[some], kind="stable")]
                left_of, at = left[some], 0  # what did not fit once does not fit later
                while room and at < len(some):
                    fits = left_of[at:] <= room
                    step = int(fits.argmax())
                    if not fits[step]:
                        break
                    at += step
                    sequence.append((int(doc[some[at]]), int(start[some[at]]), int(left_of[at])))
                    room -= int(left_of[at])
                    left[some[at]] = 0
                    at += 1
            rest = best[left[best] > 0][:1] if room >= MIN_CUT else best[:0]
            if room >= MIN_CUT and not len(rest) and len(others := others[left[others] > 0]):
                rest = others[[score[others].argmax()]]
            for best in rest:
                sequence.append((int(doc[best]), int(start[best]), room))
                start[best] += room
                left[best] -= room
        out.append(sequence)
    return out


TOKENS = "doc_id long, th long, n int, ids binary, term int, pieces long"
#: Rows of the terms' counts that hold the number of pieces and of their tokens.
ALL, LENGTH = -1, -2


def _unpacked(n: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _tokenized(tokenizer_path: str | None, window: int):
    """Each document's ids, and at a task's end in how many of its pieces each term is."""
    names = [x.split()[0] for x in TOKENS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokens.load(tokenizer_path)
        kind = np.dtype("<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        df, pieces, length = np.zeros(max(encoder.tokenizer.get_vocab_size(), END + 1), np.int64), 0, 0
        for batch in (b.slice(a, STEP) for b in batches for a in range(0, b.num_rows, STEP)):
            n, packed = [], []
            for ids in encoder.encode(batch.column("text").to_pylist(), END):
                ids = ids.astype(kind)
                n.append(len(ids))
                packed.append(ids.tobytes())
                rest = len(ids) % window
                df[counted(ids[len(ids) - rest :])[0]] += 1
                pieces, length = pieces + (rest > 0), length + rest
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int32()), pa.array(packed, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())], names)
        term = np.flatnonzero(df)
        rows = np.r_[term, ALL, LENGTH], np.r_[df[term], pieces, length]
        empty = [pa.nulls(len(rows[0]), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(rows[0].astype(np.int32)), pa.array(rows[1])], names)

    return run


class Keys:
    """The terms' random order, and each document's first three terms in it; terms that less than two pieces have are none."""

    def __init__(self, statistics: Statistics):
        draws = mix(np.arange(len(statistics.df), dtype=np.uint64)).astype(np.float64) / 2.0**64
        cost = np.where(statistics.df > 1, -np.log(draws + 1e-300) / np.maximum(statistics.idf, 1e-9), np.inf)
        order = np.argsort(cost, kind="stable")
        self.none = int((statistics.df > 1).sum())
        self.rank = np.full(len(order) + 1, self.none, np.int64)  # the last place is for terms that no piece has
        self.rank[order[: self.none]] = np.arange(self.none)

    def first_three(self, pieces: list[np.ndarray]) -> np.ndarray:
        """A row of three for each piece."""
        out = np.full((len(pieces), 3), self.none, np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        some = np.flatnonzero(size)
        if len(some):
            r = self.rank[np.minimum(np.concatenate(pieces), len(self.rank) - 1)]
            begin = np.cumsum(size[some]) - size[some]
            for k in range(3):
                out[some, k] = least = np.minimum.reduceat(r, begin)
                r[r == np.repeat(least, size[some])] = self.none
        return out

    def begins(self, firsts: np.ndarray) -> np.ndarray:
        """Where the documents of each first term begin, as a share of all."""
        return np.r_[0.0, np.cumsum(firsts / max(1, firsts.sum()))]


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in (b.slice(a, STEP) for b in batches for a in range(0, b.num_rows, STEP)):
        yield batch, [_unpacked(n, ids)[n - n % window :] for n, ids in zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True)]


def _firsts(keys: Keys, window: int):
    """How many of a task's documents have each first term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(keys.none + 1, np.int64)
        for _, pieces in _pieces(batches, window):
            counts += np.bincount(keys.first_three(pieces)[:, 0], minlength=keys.none + 1)
        first = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(counts[first])], ["first", "docs"])

    return run


DEALT = "shard int, at double, doc_id long, th long, n int, ids binary"


def _dealt(keys: Keys, begins: np.ndarray, window: int, shards: int):
    """The documents with their shard and place there. Those that share all their key, or have less than two terms in it, are spread by a hash."""
    share = lambda x: mix(x).astype(np.float64) / 2.0**64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pieces in _pieces(batches, window):
            key, own = keys.first_three(pieces), share(batch.column("th").to_numpy().view(np.uint64))
            place = np.where(key[:, 1] == keys.none, own, (1 - SPREAD) * share((key[:, 1] << 20 | key[:, 2]).astype(np.uint64)) + SPREAD * own)
            at = begins[key[:, 0]] + place * (begins[key[:, 0] + 1] - begins[key[:, 0]])
            shard = np.minimum((at * shards).astype(np.int32), shards - 1)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(at), *[batch.column(c) for c in ("doc_id", "th", "n", "ids")]], ["shard", "at", "doc_id", "th", "n", "ids"])

    return run


def _statistics(tokens: DataFrame) -> Statistics:
    counts = {r["term"]: r["pieces"] for r in tokens.where("term IS NOT NULL").groupBy("term").agg(F.sum("pieces").alias("pieces")).collect()}  # the vocabulary at most
    df = np.zeros(max([END, *counts]) + 1, np.int64)
    for term, n in counts.items():
        if term >= 0:
            df[term] = n
    return Statistics(counts.get(ALL, 0), counts.get(LENGTH, 0) / max(1, counts.get(ALL, 0)), df)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("th"), "text")
    shards = max(1, -(-docs.count() // shard_rows))
    tokens = materialise(texts.mapInArrow(lean(_tokenized(tokenizer_path, window), WordTokens.KEPT), TOKENS), compressed=False)
    statistics = _statistics(tokens)
    keys = Keys(statistics)
    ids = tokens.where("ids IS NOT NULL").select("doc_id", "th", "n", "ids")
    counts = ids.mapInArrow(lean(_firsts(keys, window)), "first long, docs long").groupBy("first").agg(F.sum("docs").alias("docs")).collect()  # the vocabulary at most
    firsts = np.zeros(keys.none + 1, np.int64)
    for r in counts:
        firsts[r["first"]] = r["docs"]
    dealt = ids.mapInArrow(lean(_dealt(keys, keys.begins(firsts), window, shards)), DEALT).repartitionById(shards, "shard").sortWithinPartitions("shard", "at", "doc_id", "th")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(shard: int, part: int, ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
            rows = []
            for k, sequence in enumerate(pack([len(t) for t in tokens], tokens, window, statistics)):
                offset = 0
                for d, start, n in sequence:
                    rows.append((ids[d], start, n, zlib.crc32(tokens[d][start : start + n].astype("<u4").tobytes()), len(tokens[d]), (shard << 40) + (part << 20) + k, offset))
                    offset += n
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        shard, part, ids, tokens, held = None, 0, [], [], 0
        for batch in batches:
            for s, d, n, t in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "ids")), strict=True):
                if ids and (s != shard or held > SHARD_TOKENS or len(ids) >= SHARD_EXCESS * shard_rows):
                    yield flush(shard, part, ids, tokens)
                    part, ids, tokens, held = (part + 1 if s == shard else 0), [], [], 0
                shard, held = s, held + n
                ids.append(d)
                tokens.append(_unpacked(n, t))
        if ids:
            yield flush(shard, part, ids, tokens)

    return dealt.mapInArrow(lean(packed), SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
