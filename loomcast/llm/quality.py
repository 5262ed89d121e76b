"""Quality classifier: supervised subword embeddings.

Hashed words, hashed character n-grams and word repetitions have learned vectors; a document is the average of its
vectors, kind by kind, and a softmax over it gives the class. Vectors and output weights are learned together by plain numpy
stochastic gradient descent on a bounded sample. Scoring uses that the network is linear up to the softmax: each bucket's
vector is multiplied with the output weights once, and a document's score is an average of numbers.

Defined cases: null and empty texts, and texts of white space alone, score by the bias alone (white space by its n-grams, too); equal texts have
equal scores, wherever they stand; very long texts are read whole, in the fit too as long as they fit in ``SAMPLE_BYTES``; equal class scores give
0.5; extra columns are ignored; an empty table gives an empty result; without labels of both classes every score is the known class's (0.5 with none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from loomcast.llm import _text
from loomcast.llm._sampling import SAMPLE_BYTES, SAMPLE_PER_LABEL, labelled_sample

BUCKETS, NGRAM, DIM, EPOCHS, RATE = 1 << 15, 3, 8, 8, 1.0
_WORDS = _text.byte_table(lambda b: b == 0x20 or 9 <= b <= 13, lower=False)


def features(raw: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers and row bounds of each kind: words, character n-grams, whether a word repeats the one before."""
    mapped = _WORDS[raw]
    w = _text.words(mapped, off)
    h = _text.span_hashes(mapped, w.start, w.end)
    again = np.zeros(len(h), np.int64)
    again[1:] = h[1:] == h[:-1]
    again[w.bounds[:-1][w.counts > 0]] = 0  # a text's first word
    grams = _text.byte_ngrams(raw, NGRAM)
    whole = np.ones(len(raw) + NGRAM, bool)
    for k in range(1, NGRAM):  # not over two texts
        whole[off[1:] - k] = False
    own = np.flatnonzero(whole[: len(grams)])
    return [((h % BUCKETS).astype(np.int64), w.bounds), ((grams[own] % np.uint32(BUCKETS)).astype(np.int64) + BUCKETS, np.searchsorted(own, off)), (again + 2 * BUCKETS, w.bounds)]


class QualityModel:
    """Learned vectors folded with the softmax's weights: ``logit`` has each bucket's share of the class-1 log-odds."""

    def __init__(self, logit: np.ndarray, bias: float):
        self.logit, self.bias = logit, bias

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = np.full(len(off) - 1, self.bias)
        for ids, bounds in features(raw, off):
            n = np.diff(bounds)
            z += _text.row_sums(self.logit[ids], bounds) / np.maximum(n, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def train(sample: list[tuple[str, int]], counts: dict, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent over the sample, then the bias is moved from the sample's class shares to the table's."""
    n_features = 2 * BUCKETS + 2
    if len({y for _, y in sample}) < 2:
        known = sample[0][1] if sample else 0.5
        return QualityModel(np.zeros(n_features), {1: 6.0, 0: -6.0}.get(known, 0.0))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (n_features, DIM)) / DIM
    out, bias = np.zeros((2, DIM)), np.zeros(2)
    bags = []
    for text, y in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, weights = [], []
        for f, _ in features(raw, np.array([0, len(raw)])):
            u, c = np.unique(f, return_counts=True)
            ids.append(u)
            weights.append(c / max(1, len(f)))
        bags.append((np.concatenate(ids), np.concatenate(weights), int(y)))
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, weights, y = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = weights @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            back = p @ out
            out -= 0.1 * rate * np.outer(p, hidden)
            bias -= 0.02 * rate * p
            vectors[ids] -= rate * np.outer(weights, back)
    own = np.bincount([y for _, _, y in bags], minlength=2)
    shift = np.log(max(counts.get(1, 1), 1) / max(counts.get(0, 1), 1)) - np.log(own[1] / own[0])
    return QualityModel((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0] + shift))


def fit(documents: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", per_label: int = SAMPLE_PER_LABEL, total_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Learns from at most ``per_label`` labelled rows of each class that meet ``allowed``, of ``total_bytes`` in all."""
    model = train(*labelled_sample(documents, labels, label, allowed, per_label, total_bytes))
    _text.give_back()  # the sample's: the driver goes on
    return model


def score(documents: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row; one map over the table, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast((model.logit, model.bias))

    def run(batches):
        m = QualityModel(*shared.value)
        for b in _text.small(batches, 1):
            out = [m.score(raw, off) for _, _, raw, off in _text.chunks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(_text.released(run), "doc_id long, score double")


def keep_good(documents: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is at least ``least``."""
    shared = documents.sparkSession.sparkContext.broadcast((model.logit, model.bias))
    at = documents.columns.index("text")

    def run(batches):
        m = QualityModel(*shared.value)
        for b in _text.small(batches, at):
            out = [m.score(raw, off) for _, _, raw, off in _text.chunks(b.column(at))]
            yield b.filter(pa.array(np.concatenate(out) >= least if out else np.zeros(0, bool)))

    plain = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])  # names with dots don't go through an Arrow map
    return plain.mapInArrow(_text.released(run), plain.schema).toDF(*documents.columns)
