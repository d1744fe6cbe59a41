"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, any documents of the training fold the unlabelled ones.  Features are the presence of words and of
word beginnings; those that stand out among the positives are kept.  A linear classifier minimises, with the class prior p,

    p * E_P[loss(+)] + max(0, E_U[loss(-)] - p * E_P[loss(-)])

where the second term is the risk on negatives, estimated from unlabelled documents corrected for the positives among them; it
can't be negative, so where its estimate is, the step goes back up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, shared, training, winnow

#: Training documents of either kind.
POSITIVES, UNLABELLED = 2000, 4000
FEATURES = 400
#: Beginnings of words, in bytes.
BEGINNINGS = (4, 5, 6, 8)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit hash of every feature's occurrences."""
    w = winnow.WordSpans(texts, winnow.SIGNS, winnow.FOLD)
    prefix = winnow.Prefix(winnow.byte_values(0x5851F42D4C957F2D)[w.raw], winnow.BASE_2)
    text = np.repeat(np.arange(len(texts)), w.last - w.first)
    found, where = [prefix.spans(w.begin, w.end)], [text]
    for k in BEGINNINGS:
        long = w.end - w.begin > k
        found.append(prefix.spans(w.begin[long], w.begin[long] + k) ^ np.uint64(k))
        where.append(text[long])
    return np.concatenate(where), np.concatenate(found)


#: Texts are turned into features so many at a time.
TEXTS_AT_ONCE = 100


def presence(texts: list[bytes], known: np.ndarray) -> np.ndarray:
    """Which of the known (sorted) features each text has."""
    out = np.zeros((len(texts), len(known)), np.float32)
    for a in range(0, len(texts) if len(known) else 0, TEXTS_AT_ONCE):
        text, hashes = features(texts[a : a + TEXTS_AT_ONCE])
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        out[a + text[hit], at[hit]] = 1
    return out


@dataclass
class Classifier:
    known: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(presence(texts, self.known).astype(float) @ self.weights + self.bias)))


def document_counts(texts: list[bytes], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features (of the sorted ones in only) and the number of texts that have each; slices keep the memory bounded."""
    found = []
    for a in range(0, len(texts), TEXTS_AT_ONCE):
        text, hashes = features(texts[a : a + TEXTS_AT_ONCE])
        if only is not None and len(only):
            known = only[np.minimum(np.searchsorted(only, hashes), len(only) - 1)] == hashes
            text, hashes = text[known], hashes[known]
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        found.append(hashes[new])
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)


def select(positive: list[bytes], unlabelled: list[bytes], prior: float, n: int = FEATURES) -> np.ndarray:
    """The features whose share among positives most exceeds that among unlabelled texts, beyond what the positives there explain."""
    known, count = document_counts(positive)
    known, count = known[count >= 3], count[count >= 3]
    seen, elsewhere = document_counts(unlabelled, known)
    share = count / max(1, len(positive))
    at = np.minimum(np.searchsorted(seen, known), max(0, len(seen) - 1))
    there = np.where(seen[at] == known, elsewhere[at], 0) / max(1, len(unlabelled)) if len(seen) else np.zeros(len(known))
    clean = np.maximum(0, there - prior * share)
    # Cautious bounds of both shares, so that few positives don't make chance look like a sign.
    low = share - 1.5 * np.sqrt(share * (1 - share) / max(1, len(positive)))
    high = clean + 1.5 * np.sqrt(clean / max(1, len(unlabelled))) + 1 / max(1, len(unlabelled))
    gain = np.where(low > 5 * high, share * np.log(np.maximum(low, 1e-9) / high), 0)
    best = np.argsort(-gain, kind="stable")[:n]
    return np.sort(known[best[gain[best] > 0]])


def risk(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The logistic risk of positives, weighted by the prior, the corrected risk of negatives, and the direction of descent.

    Positives hidden among the unlabelled are taken out of the negatives' risk: mean loss of xu as negatives less prior times that of xp as negatives.
    Where that falls below zero, which no true risk does, it alone is pushed up again; else the gradient is that of the sum.
    """
    zp, zu = xp @ w + b, xu @ w + b
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))

    def mean(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(x.T @ slope, slope.sum()) / len(x)

    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    of_negatives = mean(xu, su) - prior * mean(xp, sp)
    return positive, negative, prior * mean(xp, sp - 1) + of_negatives if negative >= 0 else -of_negatives


def fit(positive: list[bytes], unlabelled: list[bytes], prior: float, rounds: int = 300, decay: float = 3e-4) -> Classifier:
    if not positive or not unlabelled:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-3) / (1 - min(prior, 1 - 1e-3)))))
    known = select(positive, unlabelled, prior)
    xp = presence(positive, known)
    xu = presence(unlabelled, known)
    w, b = np.zeros(len(known)), -2.0
    state = [np.zeros(len(known) + 1), np.zeros(len(known) + 1)]
    for t in range(1, rounds + 1):
        gradient = risk(w, b, xp, xu, prior)[2] + decay * np.append(w, 0)
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return Classifier(known, w, b)


def train(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """A classifier from at most so many documents of either kind; the class prior is the training fold's share of toxic labels."""
    p = training.labelled(documents, labels, "toxic", positives, only=1)
    u = training.unlabelled(documents, unlabelled)
    return fit([t.encode() for t in p["text"]], [t.encode() for t in u["text"]], training.prior(labels, "toxic"))


def score(df: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id and score of every row of df(doc_id, text, ...).

    A text without words (null and empty ones too) has no features and gets the classifier's bias alone.  Rows are scored one by one, so
    repeated rows give repeated results; other columns are left out.
    """
    shared.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in repeats.slices(b)):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(classifier.scores(repeats.utf8(part.column("text"))))], names=["doc_id", "score"])

    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
