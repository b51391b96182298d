"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers, one in each direction, read a text's bytes and label every position with a language; a document's
probabilities are the mean over its positions. Texts are read whole, in windows of WINDOW bytes that start from a
zero state, so that many windows of many documents advance together as one matrix. Training is backpropagation through time, in numpy.

Defined cases: a null text, or one without a letter, is `und` with score 0; without labelled rows every text is `und`; with one label every text with a letter has it; a
text of repeated rows is read for each row; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import documents, fold_mod, materialise, with_fields

#: At most so many labelled documents are used for training, those first in a seeded order for each language, and at most as many languages, the most
#: frequent. Of each document the tasks cut at most so many windows, at random places of the whole text.
MAX_TRAINING_ROWS, CUTS = 1_500, 64
HELD_OUT_FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
WINDOW, HIDDEN = 64, 8
#: Windows that advance together in a task: bounds its memory.
BLOCK = 8192
PAD = 0


@dataclass
class Direction:
    """Rows of `byte` are the inputs of the three gates (update, reset, new) for each byte, biases included; `state` is their recurrence."""

    byte: np.ndarray  # 3, 256, H
    state: np.ndarray  # 3, H, H

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each step for x of shape (steps, windows), and what `backward` needs."""
        h = np.zeros((x.shape[1], self.state.shape[1]), np.float32)
        out, tape = np.empty((*x.shape, h.shape[1]), np.float32), []
        for t, b in enumerate(x):
            z = 0.5 + 0.5 * _squash(self.byte[0].take(b, axis=0) + h @ self.state[0])
            r = 0.5 + 0.5 * _squash(self.byte[1].take(b, axis=0) + h @ self.state[1])
            u = h @ self.state[2]
            n = _squash(self.byte[2].take(b, axis=0) + r * u)
            tape.append((h, z, r, u, n))
            h = n + z * (h - n)
            out[t] = h
        return out, tape

    def run(self, x: np.ndarray) -> np.ndarray:
        """The states of `forward`, for scoring, in buffers that are used again."""
        w, size = x.shape[1], self.state.shape[1]
        out = np.empty((x.shape[0], w, size), np.float32)
        z, r, n, u = (np.empty((w, size), np.float32) for _ in range(4))
        h = np.zeros((w, size), np.float32)
        for t, b in enumerate(x):
            for k, gate in ((0, z), (1, r)):
                np.matmul(h, self.state[k], out=gate)
                np.take(self.byte[k], b, axis=0, out=u, mode="clip")
                gate += u
                np.abs(gate, out=u)
                u += 1
                gate /= u
                gate *= 0.5
                gate += 0.5
            np.matmul(h, self.state[2], out=n)
            n *= r
            np.take(self.byte[2], b, axis=0, out=u, mode="clip")
            n += u
            np.abs(n, out=u)
            u += 1
            n /= u
            np.subtract(h, n, out=u)
            u *= z
            h = np.add(n, u, out=out[t])
        return out

    def backward(self, x: np.ndarray, tape: list, dout: np.ndarray) -> list[np.ndarray]:
        dbyte, dstate = np.zeros_like(self.byte), np.zeros_like(self.state)
        steps = np.empty((3, *dout.shape), np.float32)
        dh = np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, u, n = tape[t]
            dh = dh + dout[t]
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dr = dn * u * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            back = dh * z
            for k, (d, s) in enumerate(((dz, dz), (dr, dr), (dn, dn * r))):
                steps[k, t] = d
                dstate[k] += h.T @ s
                back += s @ self.state[k].T
            dh = back
        for k in range(3):
            for j in range(dbyte.shape[2]):
                dbyte[k, :, j] = np.bincount(x.ravel(), steps[k, :, :, j].ravel(), minlength=256)
        return [dbyte, dstate]


def _squash(x: np.ndarray) -> np.ndarray:
    """The network's bounded activation, x / (1 + |x|), from -1 to 1; a gate is its half, from 0 to 1."""
    return x / (1 + np.abs(x))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis. States are within 1, so logits need no shift."""
    np.exp(x, out=x)
    x /= x @ np.ones((x.shape[-1], 1), x.dtype)
    return x


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # 2H + 1, languages

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each language at each position of x (steps, windows)."""
        a, b = self.ahead.run(x), self.back.run(x[::-1])[::-1]
        size = a.shape[2]
        return _softmax(a @ self.out[:size] + b @ self.out[size : 2 * size] + self.out[-1])

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        pooled = np.zeros((len(texts), len(self.languages)))
        lettered = [t is not None and (t[:64].isalpha() or any(map(str.isalpha, t))) for t in texts]
        if self.languages:
            parts: list[bytes] = []
            owner: list[int] = []
            held = 0
            for i, text in enumerate(texts):
                if lettered[i]:
                    raw = text.encode("utf-8", "surrogatepass")
                    parts.append(raw + bytes(-len(raw) % WINDOW))
                    owner.append(i)
                    held += len(parts[-1]) // WINDOW
                if parts and (held >= BLOCK or i == len(texts) - 1):
                    self._pool(parts, owner, pooled)
                    parts, owner, held = [], [], 0
            if parts:
                self._pool(parts, owner, pooled)
        share = pooled / np.maximum(pooled.sum(axis=1, keepdims=True), 1e-9)
        best = share.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        known = [ok and bool(self.languages) for ok in lettered]
        return [self.languages[b] if ok else UNDETERMINED for ok, b in zip(known, best, strict=True)], np.where(known, share.max(axis=1) if self.languages else 0.0, 0.0)

    def _pool(self, parts: list[bytes], owner: list[int], pooled: np.ndarray) -> None:
        windows = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW)
        of = np.repeat(owner, [len(p) // WINDOW for p in parts])
        for a in range(0, len(windows), BLOCK):
            x = np.ascontiguousarray(windows[a : a + BLOCK].T)
            p = self.positions(x)
            short = np.flatnonzero(x[-1] == PAD)
            p[:, short] *= (x[:, short] != PAD)[:, :, None]
            summed, to = p.sum(axis=0), of[a : a + BLOCK]
            for k in range(summed.shape[1]):
                pooled[:, k] += np.bincount(to, summed[:, k], minlength=len(pooled))


def cut(text: str, seed: int, n: int = CUTS) -> list[bytes]:
    """Windows at random places of a text: one for a text of a window or less, else n."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= WINDOW:
        return [raw]
    return [raw[at : at + WINDOW] for at in np.random.default_rng(seed).integers(len(raw) - WINDOW + 1, size=n).tolist()]


def train(pieces: list[list[bytes]], languages: list[str], steps: int = 200, batch: int = 160, rate: float = 0.03, seed: int = 8) -> Network:
    """Cross-entropy of every position, Adam, gradients by backpropagation through time over random windows of the sample. pieces: each document's windows."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    near = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = Network(names, *(Direction(near(3, 256, HIDDEN), near(3, HIDDEN, HIDDEN)) for _ in range(2)), near(2 * HIDDEN + 1, len(names)))
    of = np.array([names.index(x) for x in languages])
    by_name = [np.flatnonzero(of == k) for k in range(len(names))]
    if len(names) < 2:
        return net
    weights = [net.ahead.byte, net.ahead.state, net.back.byte, net.back.state, net.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        kind = rng.integers(len(names), size=batch)
        x = np.zeros((batch, WINDOW), np.uint8)
        for i, k in enumerate(kind):
            own = pieces[rng.choice(by_name[k])]
            piece = np.frombuffer(own[rng.integers(len(own))], np.uint8)
            x[i, : len(piece)] = piece
        x = np.ascontiguousarray(x.T)
        a, tape_a = net.ahead.forward(x)
        b, tape_b = net.back.forward(x[::-1])
        both = np.concatenate([a, b[::-1], np.ones((*x.shape, 1), np.float32)], axis=2)
        d = _softmax(both @ net.out)
        d[:, np.arange(batch), kind] -= 1
        d *= (x != PAD)[:, :, None] / np.float32(x.size)
        dboth = d @ net.out.T
        grads = [
            *net.ahead.backward(x, tape_a, dboth[:, :, :HIDDEN]),
            *net.back.backward(x[::-1], tape_b, dboth[::-1, :, HIDDEN : 2 * HIDDEN]),
            both.reshape(-1, both.shape[2]).T @ d.reshape(-1, d.shape[2]),
        ]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [cut(t, i % 2**32) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "lang", "pieces"])


def fit(docs: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> Network:
    """Train on labelled documents outside the held-out fold. From each language come its first documents in a seeded
    order; ids alone decide, so the sample is small before texts are fetched, and of those only windows leave the tasks."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold_mod("doc_id", HELD_OUT_FOLDS) != HELD_OUT))
    counts = materialise(usable.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max_training_rows))
    languages = counts.count()
    if not languages:
        return train([], [])
    each = max(1, max_training_rows // languages)
    share = F.least(F.lit(1.0), F.lit(float(max(4 * each, each + 1000))) / F.col("count"))
    low = F.xxhash64("doc_id").cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)
    near = usable.select("doc_id", "lang").join(counts, "lang").where(low).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select("doc_id", F.col("lang").alias("_lang"))
    sample = F.broadcast(sample.limit(max_training_rows))
    texts = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(sample, "doc_id").where("lang = _lang").select("doc_id", "lang", "text")
    rows = texts.mapInArrow(_pieces, "doc_id long, lang string, pieces array<binary>").orderBy("doc_id", "lang", "pieces").limit(max_training_rows).toArrow()
    return train(rows["pieces"].to_pylist(), rows["lang"].to_pylist())


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of docs, and lang_pred and lang_score, which replace columns of those names. One pass, no shuffle."""
    docs = docs.drop("lang_pred", "lang_score")
    schema = with_fields(docs, lang_pred=T.StringType(), lang_score=T.DoubleType())

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = net.label(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(labelled, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = fit(docs)
    held_out = (fold_mod("doc_id", HELD_OUT_FOLDS) == HELD_OUT).alias("held_out")
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out, "lang_pred", F.col("lang_score").alias("score"))
