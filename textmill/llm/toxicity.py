"""Operator 8: a convolutional text classifier for toxicity, trained in numpy.

Words are hashed into two embedding tables, and a word's vector is the sum of
its two rows: two words share a vector only if they collide in both. Filters of
several widths run over the word vectors, their maxima over the text feed one
logistic unit. Two zero vectors follow each text, so that every width has a
place at every word.

Training takes at most TRAIN_ROWS labelled rows (a documented bound; rows
outside the held-out fold). Of these, one in five is left out of the training of
weights and serves to calibrate: for each language guessed from the text itself
the logits are shifted so that the cut that errs least lies at THRESHOLD. Neither
labels nor lang, source or doc_id enter a score. Every document is scored whole.

Defined results: a null text counts as empty and gets the score of no words;
without labelled rows every score is 0.5; a very long text is scored block by
block, with the same result; repeated rows give repeated results; other columns
are unused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_fold
from .labelled import CUT, hashes, tokens, training_rows
from .quality_fm import best_cut

TRAIN_ROWS, BITS, SIZE, WIDTHS, FILTERS, EPOCHS, THRESHOLD = 6_000, 15, 16, (1, 2, 3), 12, 4, 0.5
PAD = max(WIDTHS) - 1
#: Rows of each class that a language needs to be calibrated by itself, and words scored at a time.
LANGUAGE_ROWS, CHUNK_WORDS = 20, 60_000
#: Characters from which a text is scored block by block.
LONG_TEXT = 500_000
#: Frequent words that tell languages apart.
MARKS = {
    "en": "the of and to in is that for with was are be this it from",
    "de": "der die das und den von zu mit des im sich für ist ein eine",
    "fr": "le les des et une que qui dans pour sur est pas avec par du",
    "es": "el los las del y se por con una para su al no de la",
}
_MARKS = {k: frozenset(v.split()) for k, v in MARKS.items()}


def words_of(text: str | None) -> list[str]:
    return tokens((text or "").lower())


def votes(words: list[str]) -> np.ndarray:
    """For each language how many of its frequent words are among these."""
    return np.array([sum(map(v.__contains__, words)) for v in _MARKS.values()])


def elected(count: np.ndarray) -> str:
    """The language with most votes, of equal ones the last by name; "" without any."""
    n, k = max(zip(count.tolist(), _MARKS, strict=True))
    return k if n else ""


def language(words: list[str]) -> str:
    return elected(votes(words))


def word_blocks(text: str) -> Iterator[list[str]]:
    """The words of a very long text, CHUNK_WORDS at a time."""
    found = (m[0] for m in CUT.finditer(text.lower()))
    while block := list(islice(found, CHUNK_WORDS)):
        yield block


def slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h = np.array(hashes(words), np.uint32)
    mask = np.uint32((1 << BITS) - 1)
    return (h & mask).astype(np.int64), (h >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Net:
    e1: np.ndarray
    e2: np.ndarray
    kernel: np.ndarray  # SIZE x columns; a column for each filter and place in its width
    bias: np.ndarray
    out: np.ndarray
    c: float = 0.0
    shift: dict[str, float] = field(default_factory=dict)

    def pooled(self, docs: list[tuple[np.ndarray, np.ndarray]], starts: int | None = None) -> np.ndarray:
        """Filter maxima, after bias and rectification: texts x filters. starts: how many words of each text filters begin at."""
        result = np.zeros((len(docs), len(self.out)), np.float32)
        some = [k for k, d in enumerate(docs) if len(d[0])]
        if not some:
            return result
        zero = np.zeros((PAD, SIZE), np.float32)
        e = np.concatenate([x for k in some for x in (self.e1[docs[k][0]] + self.e2[docs[k][1]], zero)])
        places = e @ self.kernel
        begin = np.cumsum([0] + [len(docs[k][0]) + PAD for k in some[:-1]])
        stop = begin + np.array([len(docs[k][0]) if starts is None else starts for k in some])
        both = np.stack((begin, stop), 1).ravel()
        column, at = 0, 0
        for w in WIDTHS:
            n = len(places) - PAD
            conv = places[:n, column : column + FILTERS].copy()
            for j in range(1, w):
                conv += places[j : n + j, column + j * FILTERS : column + (j + 1) * FILTERS]
            top = np.maximum.reduceat(np.concatenate((conv, np.full((PAD, FILTERS), -np.inf, np.float32))), both)[::2]
            result[some, at : at + FILTERS] = np.maximum(top + self.bias[at : at + FILTERS], 0)
            column, at = column + w * FILTERS, at + FILTERS
        return result

    def pooled_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of one very long text, and its votes, in the memory of a block: a block is seen with the first words of the next."""
        top, count = np.zeros((1, len(self.out)), np.float32), np.zeros(len(_MARKS), np.int64)
        block: list[str] = []
        for more in chain(word_blocks(text), ([],)):
            if block:
                top = np.maximum(top, self.pooled([slots(block + more[:PAD])], len(block)))
                count += votes(block)
            block = more
        return top, count

    def logits(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return self.pooled(docs) @ self.out + self.c

    def scores(self, texts: list[str | None]) -> np.ndarray:
        result = np.zeros(len(texts))
        held: list[tuple[int, tuple, str]] = []
        size = 0

        def put(at: list[int], pooled: np.ndarray, langs: list[str]) -> None:
            z = (pooled @ self.out + self.c).astype(np.float64) + [self.shift.get(x, self.shift.get("", 0.0)) for x in langs]
            result[at] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        def flush() -> None:
            put([h[0] for h in held], self.pooled([h[1] for h in held]), [h[2] for h in held])

        for k, t in enumerate(texts):
            if t and len(t) >= LONG_TEXT:
                top, count = self.pooled_long(t)
                put([k], top, [elected(count)])
                continue
            words = words_of(t)
            held.append((k, slots(words), language(words)))
            size += len(words)
            if size >= CHUNK_WORDS:
                flush()
                held, size = [], 0
        if held:
            flush()
        return result


def train(rows: list[tuple[str, int]], seed: int = 11) -> Net:
    rng = np.random.default_rng(seed)
    n_filters, columns = FILTERS * len(WIDTHS), FILTERS * sum(WIDTHS)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = Net(draw(1 << BITS, SIZE) * 0.3, draw(1 << BITS, SIZE) * 0.3, draw(SIZE, columns), np.zeros(n_filters, np.float32), np.abs(draw(n_filters)))
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        return net
    words = [words_of(r[0]) for r in rows]
    docs, langs = [slots(w) for w in words], [language(w) for w in words]
    check = np.arange(len(rows)) % 5 == 0
    fit = np.flatnonzero(~check)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    g = {k: np.full_like(x, 1e-4) for k, x in (("e1", net.e1), ("e2", net.e2), ("kernel", net.kernel), ("bias", net.bias), ("out", net.out))}
    gc, rate = 1e-4, 0.05

    def step(name: str, at: object, d: np.ndarray) -> None:
        g[name][at] += d * d
        getattr(net, name)[at] -= rate * d / np.sqrt(g[name][at])

    for epoch in range(EPOCHS):
        # short texts come first in the first round: there a word stands out most
        order = fit[np.argsort([len(docs[k][0]) for k in fit], kind="stable")] if not epoch else rng.permutation(fit)
        for k in order:
            a, b = docs[k]
            if not len(a):
                continue
            e = np.concatenate((net.e1[a] + net.e2[b], np.zeros((PAD, SIZE), np.float32)))
            places, n = e @ net.kernel, len(a)
            top, where, column = [], [], 0
            for w in WIDTHS:
                conv = places[:n, column : column + FILTERS].copy()
                for j in range(1, w):
                    conv += places[j : n + j, column + j * FILTERS : column + (j + 1) * FILTERS]
                at = conv.argmax(axis=0)
                where.append(at)
                top.append(conv[at, np.arange(FILTERS)])
                column += w * FILTERS
            z = np.concatenate(top) + net.bias
            act = np.maximum(z, 0)
            d = np.float32(weight[k] * (1 / (1 + np.exp(-np.clip(act @ net.out + net.c, -30, 30))) - y[k]))
            dz = d * net.out * (z > 0)
            # only the places of the maxima have a gradient
            spots, parts, dk, column = [], [], np.zeros_like(net.kernel), 0
            for i, w in enumerate(WIDTHS):
                own = dz[i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    cols = slice(column + j * FILTERS, column + (j + 1) * FILTERS)
                    at = where[i] + j
                    dk[:, cols] = e[at].T * own
                    ok = at < n
                    spots.append(at[ok])
                    parts.append((net.kernel[:, cols] * own).T[ok])
                column += w * FILTERS
            step("out", slice(None), d * act)
            step("bias", slice(None), dz)
            step("kernel", slice(None), dk)
            gc += float(d * d)
            net.c -= rate * float(d) / gc**0.5
            spot, part = np.concatenate(spots), np.concatenate(parts)
            for name, table in (("e1", a), ("e2", b)):
                at, inverse = np.unique(table[spot], return_inverse=True)
                total = np.zeros((len(at), SIZE), np.float32)
                np.add.at(total, inverse, part)
                step(name, at, total)
    held = np.flatnonzero(check)
    logit = np.concatenate([net.logits([docs[k] for k in held[i : i + 64]]) for i in range(0, len(held), 64)]).astype(np.float64)
    net.shift = {"": -best_cut(logit, y[held])}
    for lang in _MARKS:
        own = np.array([langs[k] == lang for k in held])
        t = y[held][own]
        if min(t.sum(), len(t) - t.sum()) >= LANGUAGE_ROWS:
            net.shift[lang] = -best_cut(logit[own], t)
    return net


def score(docs: DataFrame, net: Net, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, score. The model has the same size whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()), pa.float64())], [doc_id, "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """Trains on the labelled rows, scores all: id, held_out, score, predicted."""
    net = train(training_rows(docs, labels, "toxic", rows, doc_id, text))
    scored = score(docs, net, doc_id, text)
    return scored.select(doc_id, labelled_fold(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
