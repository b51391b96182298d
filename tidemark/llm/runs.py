"""Periodic runs inside documents, by block matching with integer automata.

The words of a text become numbers. At each scale, a power of two, the text is cut into aligned blocks of that many words, an Aho-Corasick automaton over
number sequences searches all blocks in the whole text, and an occurrence at a distance that suits the scale seeds an exact extension to
both sides: the longest stretch around the seed in which words that far apart are equal. A stretch is a run if it has at least LEAST words and REPEATS
periods, and no smaller period.

Nothing is lost: scale B answers for periods from B to 2B - 1 (the smallest scale, FIRST, for all below 2 * FIRST). A run of period q has at least 2q starts
(17 where q < 8) of equal words at distance q, and any 2B - 1 consecutive words hold an aligned block. A block is searched at scale B only if
both halves came again later at scale B / 2, which such a block's halves do. Where a run of period q <= B covers a block and all its copies at this scale's distances,
each copy is a multiple of q away and its stretch ends where the run ends: such blocks are passed over.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a null id is a row like any other; each row is looked at by itself, so rows that
repeat give repeated results; columns of the results' names are replaced, all others kept; an empty table gives an empty result. A text of any length is
held whole in one task, as all of a row is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD_GAP, documents, with_fields

#: A run has at least so many words, and so many periods.
LEAST = 24
REPEATS = 3
#: Words in a block of the smallest scale. FIRST + LEAST - 1 words at least must fit into twice the smallest run, see above.
FIRST = 8

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
Run = tuple[int, int, int]


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading entries are equal, in steps that double."""
    most, at, step = min(len(x), len(y)), 0, 16
    while at < most:
        differ = np.flatnonzero(x[at : at + step] != y[at : at + step])
        if differ.size:
            return at + int(differ[0])
        at, step = at + step, step * 2
    return most


def _stretch(a: np.ndarray, p: int, d: int, size: int) -> tuple[int, int]:
    """Start and end of the longest stretch around the block at p in which words d apart are equal."""
    right = _agree(a[p + size : len(a) - d], a[p + d + size :])
    left = _agree(a[:p][::-1], a[d : p + d][::-1])
    return p - left, p + size + right + d


def _primitive(block: np.ndarray) -> bool:
    """Whether a block isn't a shorter one repeated."""
    d, rest, r = len(block), len(block), 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            q = d // r
            if np.array_equal(block[: d - q], block[q:]):
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def _again(ids: tuple[int, ...], starts: Sequence[int], size: int, low: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Search the blocks at these starts. (distance, start) of each occurrence that is `low` to 2 * size - 1 words after its block, and the starts of
    blocks that come again at any later place."""
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    number: dict[int, int] = {}
    for p in starts:
        key = ids[p : p + size]
        k = found.get(key, None)
        if k is None:
            k = p
            found.add_word(key, k)
        number[p] = k
    found.make_automaton()
    seeds, last = [], {}
    for end, k in found.iter(ids):
        o = end - size + 1
        last[k] = o
        p = (o - low) // size * size
        while p > o - 2 * size and p >= 0:
            if number.get(p) == k:
                seeds.append((o - p, p))
            p -= size
    return seeds, {p for p, k in number.items() if last[k] > p}


def periodic_runs(words: Sequence) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    known: dict = {}
    ids = tuple([known.setdefault(w, len(known)) for w in words])
    if len(known) == n:
        return []
    a = np.array(ids, np.int64)
    runs: list[Run] = []
    cover = np.zeros(n, np.int64)  # end of the longest run, of a period of at most the scale, around a word
    size, low, later = FIRST, 1, []
    again = set()
    while size == FIRST or size * REPEATS <= n:
        blocks = range(0, n - size - low + 1, size)
        if size > FIRST:
            blocks = [p for p in blocks if p in again and p + size // 2 in again]
        free = [p for p in blocks if cover[p] < p + 3 * size]
        covered = set(blocks).difference(free) if len(free) < len(blocks) else set()
        if not blocks:
            break
        seeds, again = _again(ids, free, size, low) if free else ([], set())
        again |= covered
        now, start, end = 0, 0, 0
        for d, p in sorted(seeds):
            if d == now and start <= p and p + size + d <= end or cover[p] >= p + size + d:
                continue
            now, (start, end) = d, _stretch(a, p, d, size)
            if end - start >= max(LEAST, REPEATS * d) and _primitive(a[start : start + d]):
                runs.append((start, end - start, d))
                if d <= size:
                    np.maximum(cover[start:end], end, out=cover[start:end])
                else:
                    later.append((start, end))
        for s, e in later:
            np.maximum(cover[s:e], e, out=cover[s:e])
        later = []
        size *= 2
        low = size
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run with most periods; ties by start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words: Sequence, runs: list[Run]) -> list:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return list(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def find_runs(docs: DataFrame, names: tuple[str, str, str, str] = ("n_words", "runs", "strongest", "collapsed")) -> DataFrame:
    """All columns of docs, and four more: the number of words, all runs, the strongest one (null without runs), and the text without the repeats, its words joined by a space.
    One pass over the table, no shuffle."""
    docs = docs.drop(*names)
    schema = with_fields(docs, **dict(zip(names, (T.LongType(), T.ArrayType(RUN), RUN, T.StringType()), strict=True)))
    types = [pa.int64(), pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields])), pa.struct([(f.name, pa.int64()) for f in RUN.fields]), pa.string()]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named(run: Run | None) -> dict | None:
            return run and dict(zip(("start", "length", "period"), run, strict=True))

        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for text in batch.column("text"):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                runs = periodic_runs(words)
                for column, value in zip(columns, (len(words), [named(r) for r in runs], named(strongest(runs)), b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [*batch.schema.names, *names])

    return docs.mapInArrow(searched, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: with h the crc32 of the id and g a tenth of it, every tenth document by h repeats, from word g % n on, as many words as fit 3 + g % 8 times into the rest."""
    h, words = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.array_remove(F.split(F.coalesce("text", F.lit("")), WORD_GAP), "")
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")).otherwise("")

    # the words are bound to a name by a transform of one element, so that they are cut once
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(documents(spark, sf_dir)))
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
