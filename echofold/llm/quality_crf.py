"""Document quality by a linear-chain conditional random field over lines.

A line's features are shares of character classes, repetition and length, and those of the lines before and after it.  The
chain labels each line good or bad; forward-backward gives each line's probability of being good, and their mean, weighted by
length, is the document's quality.  A two-parameter logistic curve, fitted on the training documents, turns it into the score.

Only documents have labels.  The chain is fitted twice: first with each document's label on all its lines, then, in bad documents, with
the lines that the first chain finds bad (all of them if it finds none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, shared, training, winnow

#: Labelled documents that the chain is fitted on.
SAMPLE = 4000
BAD, GOOD = 0, 1

CLASSES = [
    winnow.byte_class(lambda b: 0x41 <= b <= 0x5A),  # capitals
    winnow.byte_class(lambda b: 0x61 <= b <= 0x7A),
    winnow.byte_class(lambda b: b >= 0x80),
    winnow.byte_class(lambda b: 0x30 <= b <= 0x39),
    winnow.byte_class(lambda b: b == 0x21),  # !
    winnow.byte_class(lambda b: b in b"#$%&*@^~=+<>{}[]\\_"),
    winnow.byte_class(lambda b: b == 0x7C),  # |
    winnow.byte_class(lambda b: b in b".,;:?'\"()-"),
]
#: Own features of a line: the classes' shares, then words like the one before, distinct words, a line like the one before, word length, length.
OWN = len(CLASSES) + 5
WIDTH = 3 * OWN + 1


def lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that aren't blank, their lengths in bytes, and the text of each."""
    w = winnow.WordSpans(texts)
    if not len(w.begin):
        return np.zeros((0, WIDTH)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.cumsum(w.raw == 0x0A)
    # Lines by the line breaks before their first word; the break between texts counts too.
    row = breaks[w.begin]
    head = np.ones(len(row), bool)
    head[1:] = row[1:] != row[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(row)) - 1
    begin, end = w.begin[first], w.end[last]
    size = end - begin
    n_words = last - first + 1
    out = np.empty((len(first), OWN))
    for k, members in enumerate(CLASSES):
        total = np.concatenate(([0], np.cumsum(members[w.raw], dtype=np.int32)))
        out[:, k] = (total[end] - total[begin]) / size
    values = w.values()
    again = np.zeros(len(values), bool)
    again[1:] = (values[1:] == values[:-1]) & ~head[1:]
    line = np.cumsum(head) - 1
    out[:, -5] = np.add.reduceat(again.astype(np.int64), first) / n_words
    order = np.lexsort((values, line))
    v, ln = values[order], line[order]
    distinct = np.ones(len(v), bool)
    distinct[1:] = (v[1:] != v[:-1]) | (ln[1:] != ln[:-1])
    out[:, -4] = np.bincount(ln, distinct, len(first)) / n_words
    whole = np.add.reduceat(winnow.mix(values) * winnow.powers(winnow.BASE_1, len(values)), first) * winnow.powers(winnow.inverse(winnow.BASE_1), len(values))[first]
    text = np.searchsorted(w.offset, begin, side="right") - 1
    new = np.ones(len(first), bool)
    new[1:] = text[1:] != text[:-1]
    out[1:, -3] = (whole[1:] == whole[:-1]) & ~new[1:]
    out[0, -3] = 0
    out[:, -2] = np.minimum(1, size / n_words / 20)
    out[:, -1] = np.minimum(1, np.log1p(size) / 10)
    before = np.vstack((np.zeros((1, OWN)), out[:-1]))
    before[new] = 0
    after = np.vstack((out[1:], np.zeros((1, OWN))))
    after[np.append(new[1:], True)] = 0
    return np.hstack((out, before, after, np.ones((len(out), 1)))), size, text


#: Texts are turned into features so many at a time.
TEXTS_AT_ONCE = 200


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lines() of any number of texts, in bounded memory besides the result."""
    parts = [(a, lines(texts[a : a + TEXTS_AT_ONCE])) for a in range(0, len(texts), TEXTS_AT_ONCE)] or [(0, lines([]))]
    return np.vstack([x for _, (x, _, _) in parts]), np.concatenate([n for _, (_, n, _) in parts]), np.concatenate([t + a for a, (_, _, t) in parts])


@dataclass
class Chain:
    weights: np.ndarray  # WIDTH x 2
    moves: np.ndarray  # 2 x 2
    curve: tuple[float, float] = (8.0, -4.0)
    #: The score of a document without lines.
    base: float = 0.5

    def marginals(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        return self.forward_backward(features @ self.weights, text)[0]

    def forward_backward(self, emit: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label) of every line, and the expected moves.  Texts of like position advance together, those with most lines first."""
        n = len(emit)
        _, start, size = np.unique(text, return_index=True, return_counts=True)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        grown = np.exp(emit - emit.max(axis=1, keepdims=True))
        move = np.exp(self.moves)
        forth, back = np.empty((n, 2)), np.empty((n, 2))
        active = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) if n else 0)]  # texts with more than t lines
        for t, k in enumerate(active):
            at = start[:k] + t
            x = grown[at] * (forth[at - 1] @ move if t else 1.0)
            forth[at] = x / x.sum(axis=1, keepdims=True)
        back[start + size - 1] = 1.0
        for t in range(len(active) - 2, -1, -1):
            at = start[: active[t + 1]] + t
            x = (back[at + 1] * grown[at + 1]) @ move.T
            back[at] = x / x.sum(axis=1, keepdims=True)
        p = forth * back
        p /= p.sum(axis=1, keepdims=True)
        pairs = np.flatnonzero(text[1:] == text[:-1])
        both = forth[pairs][:, :, None] * move[None] * (back[pairs + 1] * grown[pairs + 1])[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        return p, both.sum(axis=0)

    def document(self, features: np.ndarray, size: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Length-weighted mean of P(good); nan without lines."""
        good = self.marginals(features, text)[:, GOOD] if len(text) else np.zeros(0)
        with np.errstate(invalid="ignore"):
            return np.bincount(text, good * size, n) / np.bincount(text, size, n)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        m = self.document(*lines(texts), len(texts))
        a, b = self.curve
        return np.where(np.isnan(m), self.base, 1 / (1 + np.exp(-(a * np.nan_to_num(m) + b))))


def ascend(x: np.ndarray, text: np.ndarray, label: np.ndarray, rounds: int = 100, decay: float = 1e-4) -> Chain:
    """Penalised likelihood by Adam."""
    chain = Chain(np.zeros((x.shape[1], 2)), np.zeros((2, 2)))
    truth = np.eye(2)[label]
    pairs = np.flatnonzero(text[1:] == text[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[pairs], label[pairs + 1]), 1)
    state = [np.zeros_like(p) for p in (chain.weights, chain.weights, chain.moves, chain.moves)]
    for t in range(1, rounds + 1):
        p, moved = chain.forward_backward(x @ chain.weights, text)
        for k, (value, gradient) in enumerate(((chain.weights, x.T @ (truth - p) / len(x)), (chain.moves, (seen - moved) / len(x)))):
            gradient = gradient - decay * value
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * gradient
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * gradient**2
            value += 0.1 * (state[2 * k] / (1 - 0.9**t)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**t)) + 1e-8)
    return chain


def fit(texts: list[bytes], labels: np.ndarray) -> Chain:
    x, size, text = lines_of(texts)
    base = float((labels.sum() + 1) / (len(labels) + 2))
    if not len(x) or len(np.unique(labels)) < 2:
        return Chain(np.zeros((WIDTH, 2)), np.zeros((2, 2)), (0.0, float(np.log(base / (1 - base)))), base)
    first = ascend(x, text, labels[text])
    bad = first.marginals(x, text)[:, BAD] > 0.5
    none = np.bincount(text, bad, len(texts)) == 0
    chain = ascend(x, text, np.where((labels[text] == BAD) & (bad | none[text]), BAD, GOOD))
    m = chain.document(x, size, text, len(texts))
    known = ~np.isnan(m)
    m, y = m[known], labels[known].astype(float)
    a, b = 8.0, -4.0
    for _ in range(50):  # Newton's method, slightly damped towards finite values
        p = 1 / (1 + np.exp(-(a * m + b)))
        weight = p * (1 - p) + 1e-6
        gradient = np.array([((y - p) * m).sum() - 0.01 * a, (y - p).sum() - 0.01 * b])
        curvature = np.array([[(weight * m * m).sum() + 0.01, (weight * m).sum()], [(weight * m).sum(), weight.sum() + 0.01]])
        step = np.linalg.solve(curvature, gradient)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
    chain.curve, chain.base = (a, b), base
    return chain


def train(documents: DataFrame, labels: DataFrame, n: int = SAMPLE) -> Chain:
    """A chain from at most n labelled documents of the training fold."""
    sample = training.labelled(documents, labels, "quality", n)
    return fit([t.encode() for t in sample["text"]], sample["label"].to_numpy(np.int64))


def score(df: DataFrame, chain: Chain, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, and score of every row of df(doc_id, text, ...).

    Texts without a line that isn't blank (null and empty ones too) get the training fold's share of good documents.  Rows are
    scored one by one, so repeated rows give repeated results; columns that aren't named are left out, and those named must not be called
    doc_id, score or _scored.
    """
    if clash := {"doc_id", "score", "_scored"} & set(keep):
        raise ValueError(f"keep can't name {sorted(clash)}")
    shared.prepare(df.sparkSession)
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("_scored"), *keep)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in repeats.slices(batch, column="_scored"):
                s = chain.scores(repeats.utf8(part.column("_scored")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *keep)), pa.array(s)], names=["doc_id", *keep, "score"])

    return rows.mapInArrow(run, schema)
