"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else parts words; n-grams of one to three characters are hashed to buckets. Term
frequencies times inverse document frequencies, scaled to length one, feed a softmax whose weights are trained with
follow-the-regularised-leader under elastic-net penalties; a temperature is then fitted on a part of the sample that was
kept aside. Document frequencies are counted over all rows that may be learnt from, the weights are fitted on a bounded
sample of them.

Defined cases: null texts and texts without a letter are ``und`` with score 0; equal texts give equal results, wherever they stand; very long
texts are read whole; languages of equal score go by their name; extra columns are ignored; an empty table, or one in which no language is known,
gives ``und`` throughout; more than ``MAX_LABELS`` languages are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomcast.llm import _text
from loomcast.llm._linear import FTRL
from loomcast.llm._sampling import labelled_sample

BUCKETS, PER_LANGUAGE, EPOCHS, CHUNK = 1 << 12, 1500, 4, 1 << 18


def _letters() -> np.ndarray:
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def frequencies(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket (columns) in each text (rows), and whether the text has a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off]
    beyond = points >= 1 << 16
    x = _TABLE[0][np.where(beyond, 0, points)]
    if beyond.any():
        x[beyond] = [c if chr(c).isalpha() else 32 for c in points[beyond].tolist()]
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    letter = x != 32
    has = np.bincount(row[letter], minlength=n) > 0
    total = np.zeros(n * BUCKETS, np.int64)
    code = x.copy()
    for size in (1, 2, 3):
        if size > 1:
            code = (code[:-1] * np.uint32(0x01000193)) ^ x[size - 1 :]
        m = len(code)
        if m <= 0:
            break
        good = letter[:m] | letter[size - 1 :]
        good &= row[:m] == row[size - 1 :]
        if size == 3:
            good &= letter[1 : m + 1]  # not over two words
        h = code[good] * np.uint32(0x9E3779B1) + np.uint32(size)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        total += np.bincount(row[:m][good] * BUCKETS + (h >> np.uint32(20)), minlength=n * BUCKETS)
    return total.reshape(n, BUCKETS), has


class LanguageModel:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.idf, self.temperature = languages, weights, bias, idf, temperature

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = counts * self.idf
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        # row by row: a product of matrices may round a row differently by its neighbours
        return np.array([v @ self.weights for v in self.vectors(counts)]).reshape(len(counts), -1) + self.bias

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        counts, has = frequencies(raw, off)
        if not self.languages:
            return ["und"] * len(has), np.zeros(len(has))
        z = self.logits(counts) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, p.max(axis=1), 0.0)


def document_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows: sums per task, added up by Spark."""
    def run(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for _, _, raw, off in _text.chunks(b.column(0), CHUNK):
                counts, _ = frequencies(raw, off)
                df += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(BUCKETS), -1)), pa.array(np.append(df, n))], names=["bucket", "n"])

    rows = documents.select("text").where("text is not null").mapInArrow(_text.released(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:  # one row a bucket
        out[r[0]] = r[1]
    return out[:-1], int(out[-1])


def train(sample: list[tuple[str, str]], df: np.ndarray, n: int, seed: int = 11) -> LanguageModel:
    languages = sorted({y for _, y in sample})
    idf = np.log((1 + n) / (1 + df)) + 1.0
    model = LanguageModel(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), idf, 1.0)
    if not languages:
        return model
    vectors = []
    for text, _ in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        v = model.vectors(frequencies(raw, np.array([0, len(raw)]))[0])[0]
        ids = np.flatnonzero(v)
        vectors.append((np.append(ids, BUCKETS), np.append(v[ids], 0.2)))
    rng = np.random.default_rng(seed)
    aside = rng.random(len(sample)) < 0.2
    learner = FTRL(BUCKETS + 1, len(languages))
    targets = np.eye(len(languages))[[languages.index(y) for _, y in sample]]
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(~aside)):
            learner.step(*vectors[i], targets[i])
    w = learner.weights()
    model.weights, model.bias = w[:-1], 0.2 * w[-1]
    held = np.flatnonzero(aside) if aside.any() else np.arange(len(sample))
    z = np.stack([vectors[i][1] @ w[vectors[i][0]] for i in held])
    scale = np.geomspace(0.05, 5, 60)
    loss = [(np.log(np.exp((z - z.max(1, keepdims=True)) / t).sum(1)) + (z.max(1) - (z * targets[held]).sum(1)) / t).mean() for t in scale]
    model.temperature = float(scale[int(np.argmin(loss))])
    return model


def fit(documents: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from text and lang of the rows that meet ``allowed``; at most ``per_language`` rows of each language."""
    sample, _ = labelled_sample(documents, None, "lang", allowed, per_language)
    return train(sample, *document_frequencies(documents.where(allowed)))


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; one map over the table."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in _text.small(batches, 1):
            names, scores = [], []
            for _, _, raw, off in _text.chunks(b.column(1), CHUNK):
                a, s = m.predict(raw, off)
                names += a
                scores.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(_text.released(run), "doc_id long, lang_pred string, score double")
