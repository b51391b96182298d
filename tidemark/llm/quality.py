"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The trees are trained in numpy on a bounded sample of labelled rows and flattened into arrays; scoring walks all
trees for a whole batch of documents at once.

Defined cases: a null or empty text has all-zero statistics and gets the score that the trees give those; labels
other than 0 and 1 or without id are ignored; without labelled rows, or with one class alone, every score is the share
of label 1 (0.5 without rows); rows that repeat are scored one by one; further columns
are kept by `score` and `keep_good` and are no input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import documents, fold_mod, fresh, hash_bound, lean, table, with_fields

#: At most so many labelled rows are used for training, those first in a seeded order.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3
HELD_OUT_FOLDS = 5

_PUNCTUATION = [ord(c) for c in ".,;:!?'\"-|#$%&*()[]{}<>/\\=+_@~^"]
FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "newline", "not_ascii", "punctuation", "entropy",
    "most_frequent_byte", "distinct_words", "top_word", "top_five_words", "once_words", "log_line_words", "repeated_lines", "short_words", "long_words", "punctuated_words",
    *[f"byte_{c}" for c in _PUNCTUATION],
]


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [float(np.log1p(len(raw))), *[0.0] * (len(FEATURES) - 1)]
    n, m = len(raw), len(words)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = seen / n
    some = share[seen > 0]
    lengths = np.fromiter(map(len, words), np.int64, m)
    ends = sum(w[-1:] in b".,;:!?*&$%#|" for w in words)
    counts = sorted(Counter(words).values(), reverse=True)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(lengths.mean()), float(lengths.std()),
        share[65:91].sum(), share[48:58].sum(), share[10], share[128:].sum(), share[_PUNCTUATION].sum(), float(-(some * np.log2(some)).sum()),
        float(np.delete(share, 32).max()), len(counts) / m, counts[0] / m, sum(counts[:5]) / m, counts.count(1) / m,
        float(np.log1p(m / len(lines))), 1 - len(set(lines)) / len(lines), float((lengths <= 3).mean()), float((lengths >= 12).mean()), ends / m,
        *share[_PUNCTUATION],
    ]


def statistics_of(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float32).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """All trees in one set of arrays. Node i of a tree goes to child[i] if its feature is at most the threshold, else to child[i] + 1; a
    leaf is its own child and never goes right."""

    prior: float
    depth: int = 0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    child: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def score(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        out = np.full(len(x), self.prior, np.float64)
        for a in range(0, len(x) if len(self.roots) else 0, block):
            part = x[a : a + block]
            rows = np.arange(len(part))[:, None]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                at = self.child[at] + (part[rows, self.feature[at]] > self.threshold[at])
            out[a : a + block] += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """Second-order boosting of the log loss over binned features."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Trees(float(np.log(share / (1 - share))))
    rows, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    offset = np.arange(width) * bins
    cells = (binned + offset).astype(np.int64)
    share = y.mean()
    prior = float(np.log(share / (1 - share)))
    raw = np.full(rows, prior)
    roots, feature, threshold, child, value = [], [], [], [], []

    def node() -> int:
        for column, empty in ((feature, 0), (threshold, np.inf), (child, len(child)), (value, 0.0)):
            column.append(empty)
        return len(child) - 1

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(rows, np.int64)
        level = [node()]
        roots.append(level[0])
        for d in range(depth + 1):
            sums = [np.bincount(at, w, minlength=len(level)) for w in (grad, hess)]
            if d == depth:
                for k, i in enumerate(level):
                    value[i] = -rate * sums[0][k] / (sums[1][k] + l2)
                break
            flat = (at[:, None] * (width * bins) + cells).ravel()
            shape = (len(level), width, bins)
            g, h, n = (np.bincount(flat, np.repeat(w, width), minlength=np.prod(shape)).reshape(shape).cumsum(axis=2) for w in (grad, hess, np.ones(rows)))
            gt, ht, nt = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(n < least) | (nt - n < least)] = -np.inf
            best = gain.reshape(len(level), -1).argmax(axis=1)
            following, moved = [], at.copy()
            for k, i in enumerate(level):
                j, b = divmod(int(best[k]), bins)
                split = gain[k, j, b] > 1e-9 and b < len(edges[j])
                left, right = node(), node()  # a node that isn't split passes its rows to the left
                child[i] = left
                feature[i], threshold[i] = (j, edges[j][b]) if split else (0, np.inf)
                mine = at == k
                moved[mine] = 2 * k + ((binned[mine, j] > b) if split else 0)
                following += [left, right]
            at, level = moved, following
        raw += np.array([value[i] for i in level])[at]
    return Trees(prior, depth, np.array(roots, np.int32), np.array(feature, np.int32), np.array(threshold, np.float32), np.array(child, np.int32), np.array(value, np.float32))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics_of(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": pa.array(list(x), pa.list_(pa.float32()))})


def fit(docs: DataFrame, labels: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> Trees:
    """Train on labelled rows outside the held-out fold. The sample is at most max_training_rows ids, so it may be broadcast."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_mod("doc_id", HELD_OUT_FOLDS) != 0))
    below = F.xxhash64("doc_id") <= hash_bound(max_training_rows, usable.count())
    sample = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(below).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_training_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").mapInArrow(lean(_features), "doc_id long, quality int, x array<float>").orderBy("doc_id", "quality").limit(max_training_rows).toArrow()
    if not rows.num_rows:
        return train(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    return train(np.array(rows["x"].to_pylist(), np.float32), rows["quality"].to_numpy().astype(np.float64))


def score(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, names: tuple[str, str] = ("quality_score", "quality_predicted")) -> DataFrame:
    """All columns of docs, and two of the given names, which replace columns of that name. One pass over the table, no shuffle."""
    docs = docs.drop(*names)
    schema = with_fields(docs, **{names[0]: T.DoubleType(), names[1]: T.IntegerType()})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = trees.score(statistics_of(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, *names])

    return docs.mapInArrow(lean(scored), schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier predicts to be good, with all their columns."""
    names = fresh(docs, "quality_score"), fresh(docs, "quality_predicted")
    return score(docs, fit(docs, labels), names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    trees = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, trees).select("doc_id", (fold_mod("doc_id", HELD_OUT_FOLDS) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
