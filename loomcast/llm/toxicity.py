"""Toxicity by weak supervision.

Voters: terms (whole words, and word beginnings of four to six bytes, so that inflected forms count) whose share of toxic
texts stands out in the labelled sample, one voter for each of the strongest and one for each group of the rest; a short
fixed list of insults; patterns (an insult close to a second-person word, several listed terms, no listed term). A
generative model of the votes estimates each voter's accuracy by expectation-maximisation, without labels, and discounts voters
that agree more than their accuracies explain. Its posteriors are the labels that a linear classifier over the terms
and patterns is trained on (logistic loss, follow-the-regularised-leader).

Defined cases: null, empty and wordless texts score as a text without any term; without labels of both classes only the fixed
list and the patterns vote; equal texts have equal scores, wherever they stand; very long texts are read whole, in the fit too as long as they
fit in ``SAMPLE_BYTES``; terms that stand out equally go by their hash; extra columns are ignored; an empty table gives an empty result.
Near copies in the sample are learnt from once (``without_copies``); all rows are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from loomcast.llm import _text
from loomcast.llm._linear import FTRL
from loomcast.llm._sampling import SAMPLE_BYTES, labelled_sample

TERMS, SINGLE, GROUPS, BEGINNINGS, LEAST_LLR, LEAST_SHARE = 3000, 48, 12, (4, 5, 6), 12.0, 0.92
#: Clean texts outnumber toxic ones in the sample, so that chance seldom puts a term into toxic texts alone.
SAMPLE = {0: 6000, 1: 1200}
INSULTS = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "trash", "scum", "loser", "clown")
SECOND_PERSON = ("you", "your", "youre", "yourself", "du", "dein", "ihr", "tu", "toi", "vous", "usted", "eres")


def _hash(words) -> np.ndarray:
    out = []
    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        out.append(_text.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
    return np.array(out, np.uint64)


_INSULTS, _SECOND = np.sort(_hash(INSULTS)), np.sort(_hash(SECOND_PERSON))
_SALT = [np.uint64(k) for k in (0, 0xA5A5A5A5, 0x5A5A5A5A, 0x3C3C3C3C)]


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, _text.Words]:
    """Term hashes and their rows: all words, then the beginnings of longer words, size by size; and the words."""
    mapped = _text.ALNUM[raw]
    w = _text.words(mapped, off)
    row, size = w.rows, w.end - w.start
    hashes, rows = [_text.span_hashes(mapped, w.start, w.end)], [row]
    for k, salt in zip(BEGINNINGS, _SALT[1:], strict=True):
        long = size > k
        start = w.start[long]
        hashes.append(_text.span_hashes(mapped, start, start + k) ^ salt)
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows), w


def _member(sorted_values: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_values, h), len(sorted_values) - 1)
    return sorted_values[at] == h


class Terms:
    """A fixed set of terms; finds which of them, and which patterns, each text has."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.near = np.zeros(1 << 16, bool)
        for known in (self.hashes, _INSULTS, _SECOND):
            self.near[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.size = len(hashes) + 4  # the last four are patterns

    def matrix(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of each term or pattern that a text has, without repeats."""
        n = len(off) - 1
        h, rows, w = terms(raw, off)
        n_words = len(w.start)
        maybe = np.flatnonzero(self.near[(h & np.uint64(0xFFFF)).astype(np.int64)])
        hm, rm = h[maybe], rows[maybe]
        known = _member(self.hashes, hm)
        pair = np.unique(rm[known] * np.int64(self.size) + np.searchsorted(self.hashes, hm[known]))
        row, col = pair // self.size, pair % self.size
        many = np.bincount(row, minlength=n)
        word = maybe < n_words
        insult, second = np.zeros(n_words, bool), np.zeros(n_words, bool)
        insult[maybe[word]] = _member(_INSULTS, hm[word])
        second[maybe[word]] = _member(_SECOND, hm[word])
        aimed = np.zeros(n_words, bool)
        for k in (1, 2, 3):
            if n_words > k:
                same = w.rows[k:] == w.rows[:-k]
                aimed[k:] |= insult[k:] & second[:-k] & same
                aimed[:-k] |= insult[:-k] & second[k:] & same
        flags = [np.bincount(w.rows[insult], minlength=n) > 0, np.bincount(w.rows[aimed], minlength=n) > 0, many >= 3, many == 0]
        for k, f in enumerate(flags):
            at = np.flatnonzero(f)
            row, col = np.append(row, at), np.append(col, np.full(len(at), self.size - 4 + k))
        return row, col


def without_copies(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without texts that share most words with an earlier one; else a copied text's words would all stand out."""
    seen, out = set(), []
    for text, y in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        mapped = _text.ALNUM[raw]
        w = _text.words(mapped, np.array([0, len(raw)]))
        h = _text.span_hashes(mapped, w.start, w.end)
        least = [int(_text.mix(h ^ np.uint64(k)).min()) if len(h) else -1 for k in range(1, 13)]
        keys = {(k, *least[k : k + 3]) for k in range(0, 12, 3)}
        if not keys & seen:
            out.append((text, y))
        seen |= keys
    return out


def stand_out(sample: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The terms whose share of toxic texts stands out, and their shares, strongest first."""
    seen: tuple[list, list] = ([], [])
    n = [0, 0]
    for text, y in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        seen[int(y)].append(np.unique(terms(raw, np.array([0, len(raw)]))[0]))
        n[int(y)] += 1
    if not n[0] or not n[1]:
        return np.zeros(0, np.uint64), np.zeros(0)
    bad, bad_df = np.unique(np.concatenate(seen[1]), return_counts=True)
    good, good_df = np.unique(np.concatenate(seen[0]), return_counts=True)
    at = np.minimum(np.searchsorted(good, bad), len(good) - 1)
    both = np.where(good[at] == bad, good_df[at], 0)
    r = n[1] / (n[0] + n[1])
    p = bad_df / (bad_df + both)
    llr = bad_df * np.log(p / r) + both * np.log(np.maximum(1 - p, 1e-12) / (1 - r))
    a, b = bad_df / n[1], both / n[0]
    share = a / (a + b)
    keep = np.flatnonzero((llr >= LEAST_LLR) & (p > r) & (share >= LEAST_SHARE))
    keep = keep[np.lexsort((bad[keep], -llr[keep]))][:TERMS]
    return bad[keep], share[keep]


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> np.ndarray:
    """Posterior of class 1 for each row of votes (1, 0, or -1: abstains), by expectation-maximisation.

    Each voter has a rate of voting 1 and of voting 0 in either class. After every round, the correlations that
    the estimated accuracies leave unexplained give each voter the weight 1 / (1 + sum of its positive ones).
    """
    n, m = votes.shape
    for_, against = (votes == 1).astype(float), (votes == 0).astype(float)
    # voters that all but repeat each other share one voice from the start
    centred = np.concatenate((for_ - for_.mean(0), against - against.mean(0))) if n else np.zeros((1, m))
    scale = np.sqrt((centred * centred).sum(0)) + 1e-9
    weight = 1 / np.maximum((np.clip(centred.T @ centred / np.outer(scale, scale), 0, None) ** 4).sum(1), 1.0)
    q = ((for_ * weight).sum(1) + 0.5 * prior) / ((for_ * weight).sum(1) + (against * weight).sum(1) + 0.5)
    for _ in range(rounds):
        rates = []
        for c in (1 - q, q):
            total = c.sum() + 1.0
            rates.append(((c @ for_ + 0.05) / total, (c @ against + 0.05) / total))
        (f0, a0), (f1, a1) = rates
        expected = np.outer(1 - q, f0) + np.outer(q, f1)
        left = for_ - expected
        scale = np.sqrt((left * left).sum(0)) + 1e-9
        corr = (left.T @ left) / np.outer(scale, scale)
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.clip(corr, 0, None).sum(1))
        none0, none1 = np.clip(1 - f0 - a0, 1e-3, 1), np.clip(1 - f1 - a1, 1e-3, 1)
        z = np.log(prior / (1 - prior)) + (for_ * weight) @ np.log((f1 + 1e-4) / (f0 + 1e-4)) + (against * weight) @ np.log((a1 + 1e-4) / (a0 + 1e-4)) + ((1 - for_ - against) * weight) @ np.log(none1 / none0)
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q


class ToxicityModel:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.terms, self.weights, self.bias = Terms(hashes), weights, bias

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, col = self.terms.matrix(raw, off)
        z = self.bias + np.bincount(row, weights=self.weights[col], minlength=len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(sample: list[tuple[str, int]], counts: dict, seed: int = 5) -> ToxicityModel:
    sample = without_copies(sample)
    hashes, share = stand_out(sample)
    found = Terms(hashes)
    rows = []
    for text, _ in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        rows.append(found.matrix(raw, np.array([0, len(raw)]))[1])
    order = np.argsort(np.searchsorted(found.hashes, hashes))  # column -> place in `hashes`
    place = np.concatenate((np.minimum(order, SINGLE - 1), np.zeros(4, np.int64))).astype(np.int64)
    strong = order < SINGLE
    place[:-4][~strong] = SINGLE + order[~strong] % GROUPS
    place[-4:] = SINGLE + GROUPS + np.arange(4)
    votes = np.full((len(sample), SINGLE + GROUPS + 4), -1, np.int8)
    for i, cols in enumerate(rows):
        votes[i, place[cols]] = 1
    votes[:, -1] = np.where(votes[:, -1] == 1, 0, -1)  # no listed term: a vote for clean
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    own = np.mean([y for _, y in sample]) if sample else 0.5
    known = bool(n1 and n0)
    posterior = label_model(votes, float(np.clip(own, 0.05, 0.95)) if known else 0.2) if sample else np.zeros(0)
    learner = FTRL(found.size + 1, 2, alpha=0.3, l1=0.5, l2=0.5)
    rng = np.random.default_rng(seed)
    for _ in range(6):
        for i in rng.permutation(len(sample)):
            ids = np.append(rows[i], found.size)
            learner.step(ids, np.ones(len(ids)), np.array([1 - posterior[i], posterior[i]]))
    w = learner.weights()
    w = w[:, 1] - w[:, 0]
    if not known:  # the fixed list and the patterns alone
        w = np.zeros(found.size + 1)
        w[found.size - 4 : found.size - 2], w[-1] = 4.0, -3.0
    return ToxicityModel(hashes, w[:-1], float(w[-1]))


def fit(documents: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", per_label: int | dict = SAMPLE, total_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Learns from at most ``per_label`` labelled rows of each class that meet ``allowed``, of ``total_bytes`` in all; near copies among them count once."""
    return train(*labelled_sample(documents, labels, label, allowed, per_label, total_bytes))


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row; one map over the table, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in _text.small(batches, 1):
            out = [m.score(raw, off) for _, _, raw, off in _text.chunks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(_text.released(run), "doc_id long, score double")
