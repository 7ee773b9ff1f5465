"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

A text has indicators of its byte trigrams, words and word pairs, of n-grams of byte classes (letters, capitals, digits, blanks and kinds of
signs; a run of one class counts once), and of n-grams over whether a word repeats the one before. All are hashed to ``2**BITS`` places
and scaled by the log ratio of their smoothed shares in the two classes; a linear hinge-loss model is fitted to them by dual
coordinate descent, and a logistic fit on a fifth of the rows that the descent hasn't seen turns margins into probabilities.
At most about ``SAMPLE`` labelled rows outside the held-out fold are learnt from, one of each doc_id; every text is scored whole.

Null texts are empty; an empty text has the margin of no indicators. Rows that repeat are scored each. With labels of one
class or none, every score is that class's share (0.5 without labels). An empty table gives an empty result.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_py, id_and_text, labelled_texts, logistic

BITS = 18
SAMPLE = 4000
_MIX = np.uint32(2654435761)
#: The byte classes; all other bytes are of class 0. Lengths of the n-grams of classes and of repeats.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,", b"!?", b"#$%&*+/<=>@^_~|\\")
CLASS_GRAMS, REPEAT_GRAMS = (3, 5, 7), (1, 2, 3)
_CLASS = np.zeros(256, np.uint32)
for _i, _c in enumerate(CLASSES, 1):
    _CLASS[list(_c)] = _i


def _grams(codes: np.ndarray, size: int, radix: int, kind: int) -> np.ndarray:
    """A number for each n-gram of ``codes``; those of another ``kind`` differ."""
    out = np.full(max(len(codes) - size + 1, 0), kind, np.uint32)
    for k in range(size):
        out = out * np.uint32(radix) + codes[k : len(out) + k]
    return out


def indicators(text: str) -> np.ndarray:
    """The distinct places of a text's n-grams."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    classes = _CLASS[data]
    classes = classes[np.flatnonzero(np.diff(classes.astype(np.int64), prepend=-1))]
    split = raw.lower().split()
    words = np.fromiter(map(zlib.crc32, split), np.uint32, len(split))
    again = (words[1:] == words[:-1]).astype(np.uint32)
    found = [_grams(data.astype(np.uint32), 3, 256, 1), words * np.uint32(3) + np.uint32(7), words[:-1] * np.uint32(31) + words[1:]]
    found += [_grams(classes, k, 11, 100 + k) for k in CLASS_GRAMS] + [_grams(again, k, 2, 70_000 + k) * _MIX for k in REPEAT_GRAMS]
    return np.unique((np.concatenate(found) * _MIX) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class NbSvm:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum() / max(len(places), 1) ** 0.5) + self.bias

    def scores(self, texts: list[str]) -> list[float]:
        margins = np.array([self.margin(indicators(t)) for t in texts])
        return (1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -35, 35)))).tolist()


def dual_descent(places: list, scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """Hinge loss, L2 penalty: coordinate descent on the dual, a coordinate a row, rows in random order. A row is its
    places, scaled to the length of their number's root."""
    values = [scale[p] * max(len(p), 1) ** -0.5 for p in places]
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(places))
    norms = np.array([(v**2).sum() + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(places)):
            p, v = places[i], values[i]
            gradient = y[i] * (w[p] @ v + b) - 1
            fresh = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (fresh - alpha[i]) * y[i]
            if step:
                w[p] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = fresh
        if moved < 1e-4:
            break
    return w * scale, b


def fit(rows: list, labels: np.ndarray, cost: float = 1.0) -> NbSvm:
    """From the indicators of labelled texts; every fifth row is kept for the probabilities."""
    width = 1 << BITS
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
        return NbSvm(np.zeros(width), 0.0, 0.0, float(np.log(share / (1 - share))))
    kept = np.arange(len(rows)) % 5 == 0
    own = np.flatnonzero(~kept)
    if len(set(labels[own].tolist())) < 2 or len(set(labels[kept].tolist())) < 2:
        own, kept = np.arange(len(rows)), np.ones(len(rows), bool)
    counts = {c: np.ones(width) for c in (0, 1)}
    for i in own:
        counts[int(labels[i])][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    y = np.where(labels[own] == 1, 1.0, -1.0)
    weights, bias = dual_descent([rows[i] for i in own], ratio, y, np.full(len(y), cost))
    model = NbSvm(weights.astype(np.float32), float(bias), 1.0, 0.0)
    margins = np.array([model.margin(rows[i]) for i in np.flatnonzero(kept)])
    slope, offset = logistic(margins[:, None], labels[kept].astype(float), penalty=0.05)
    return NbSvm(model.weights, model.bias, float(slope), float(offset))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> NbSvm:
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indicators(t).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "label", "grams"])

    rows = labelled_texts(docs, labels, column, sample).mapInArrow(featured, "doc_id long, label int, grams binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))  # the same order in every run
    return fit([np.frombuffer(r["grams"], "<u4").astype(np.int64) for r in rows], np.array([r["label"] for r in rows], int))


def score(docs: DataFrame, model, threshold: float = 0.5, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; ``model.scores`` maps texts to probabilities."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, scores = part.column(0), sent.value.scores(part.column(1).to_pylist())
                held = [fold_py(i, folds) == held_out for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return id_and_text(docs).mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")
