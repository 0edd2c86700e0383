"""Operator 3: a factorisation machine that scores text quality.

A text becomes a sparse vector x: hashed words, and structure statistics and
metadata of the text such as its length, each cut into bins. The score is

    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the pairwise part is taken in linear time as
(|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2. It is trained in numpy on at most
TRAIN_ROWS labelled rows (a documented bound; rows outside the held-out fold),
and every document is scored whole, in its own task.

Neither labels nor lang, source or doc_id enter a score. The logits are shifted
so that the cut on the training rows that errs least lies at THRESHOLD.

Defined results: a null text counts as empty and is scored like an empty one,
from its structure statistics alone; without labelled rows every score is 0.5;
repeated rows give repeated results; other columns are unused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_fold
from .labelled import hashes, tokens, training_rows

TRAIN_ROWS, SLOTS, FACTORS, EPOCHS, THRESHOLD = 6_000, 1 << 16, 8, 6, 0.3
#: The first slots hold structure statistics and metadata, in BINS bins each.
BINS, STATS = 16, 14
FIRST_WORD = BINS * STATS


def _ratio_bin(a: float, b: float) -> int:
    return min(BINS - 1, int(BINS * a / b)) if b else 0


def _size_bin(n: float) -> int:
    return min(BINS - 1, int(np.log2(n + 1)))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values. Word values make a vector of length 1; each statistic has one slot of value 0.5."""
    t = text or ""
    words, lines = tokens(t), [x for x in t.split("\n") if x.strip()]
    h = np.array(hashes(words), np.uint64)
    n = len(h)
    slot, count = np.unique(FIRST_WORD + (h % np.uint64(SLOTS - FIRST_WORD)).astype(np.int64), return_counts=True)
    value = np.log1p(count)
    norm = np.sqrt((value**2).sum())
    pieces = t.split()
    m = len(pieces)
    distinct = len(set(pieces))
    pairs = len(set(zip(pieces, pieces[1:], strict=False)))
    upper = sum(map(str.isupper, pieces))
    signs = sum(not x.isalnum() for x in words)
    stats = (
        _size_bin(len(t)), _size_bin(m), _size_bin(len(lines)), _ratio_bin(distinct, m), _ratio_bin(pairs, max(1, m - 1)),
        _ratio_bin(upper, m), _ratio_bin(signs, max(1, n)), _ratio_bin(len(lines) - len(set(lines)), len(lines)),
        min(BINS - 1, int(len(t) / max(1, m))), _ratio_bin(sum(c in "#*$%&|<>" for c in t), len(t)), _ratio_bin(8 * t.count("!"), len(t) + 1),
        _ratio_bin(sum(map(str.isdigit, pieces)), m), min(BINS - 1, int(m / max(1, len(lines)) / 4)), _ratio_bin(int(count.max()) if n else 0, max(1, n)),
    )
    place = np.arange(STATS) * BINS + np.array(stats)
    return np.concatenate((place, slot)), np.concatenate((np.full(STATS, 0.5), value / norm if n else value)).astype(np.float32)


@dataclass
class Machine:
    """b, w, v as above; `shift` moves the best cut of the training rows to THRESHOLD."""

    b: float
    w: np.ndarray
    v: np.ndarray
    shift: float = 0.0

    def logits(self, xs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        slot, value = np.concatenate([x[0] for x in xs]), np.concatenate([x[1] for x in xs])
        begin = np.cumsum([0] + [len(x[0]) for x in xs[:-1]])
        vx = self.v[slot] * value[:, None]
        pair = 0.5 * (np.add.reduceat(vx, begin) ** 2 - np.add.reduceat(vx**2, begin)).sum(axis=1)
        return self.b + np.add.reduceat(self.w[slot] * value, begin) + pair + self.shift

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logits([features(t) for t in texts]).astype(np.float64), -30, 30)))


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The cut, midway between two logits, that makes the sum of both classes' error shares least."""
    order = np.argsort(logit, kind="stable")
    z, t = logit[order], y[order]
    errors = np.cumsum(t) / max(1, t.sum()) + (len(t) - t.sum() - np.cumsum(1 - t)) / max(1, len(t) - t.sum())
    k = int(np.argmin(errors[:-1])) if len(z) > 1 else 0
    return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)


def train(rows: list[tuple[str, int]], seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad, one row at a time in a fixed random order."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SLOTS, np.float32), rng.normal(0, 0.05, (SLOTS, FACTORS)).astype(np.float32))
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        machine.v[:] = 0
        return machine
    xs = [features(r[0]) for r in rows]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    gw, gv, gb = np.full(SLOTS, 1e-6, np.float32), np.full((SLOTS, FACTORS), 1e-6, np.float32), 1e-6
    rate, decay = 0.1, 1e-5
    w, v = machine.w, machine.v
    for _ in range(EPOCHS):
        for k in rng.permutation(len(xs)):
            s, x = xs[k]
            vs = v[s]
            total = x @ vs
            z = machine.b + w[s] @ x + 0.5 * (total @ total - ((vs * x[:, None]) ** 2).sum())
            g = np.float32(weight[k] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k]))
            dw = g * x + decay * w[s]
            dv = g * x[:, None] * (total - vs * x[:, None]) + decay * vs
            gw[s] += dw**2
            gv[s] += dv**2
            gb += g * g
            w[s] -= rate * dw / np.sqrt(gw[s])
            v[s] -= rate * dv / np.sqrt(gv[s])
            machine.b -= float(rate * g / np.sqrt(gb))
    logit = np.concatenate([machine.logits(xs[a : a + 256]) for a in range(0, len(xs), 256)])
    machine.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - best_cut(logit, y)
    return machine


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, score. The model is SLOTS x (FACTORS + 1) numbers, whatever the size of the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, len(whole), 256)):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()), pa.float64())], [doc_id, "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """Trains on the labelled rows, scores all: id, held_out, score, predicted."""
    machine = train(training_rows(docs, labels, "quality", rows, doc_id, text))
    scored = score(docs, machine, doc_id, text)
    return scored.select(doc_id, labelled_fold(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
