"""Token counts by rank-synchronous array merging.

A batch of pre-tokens is one ragged array of symbols.  In each round every pre-token merges all occurrences of its own
lowest-ranked pair at once; a pre-token without a mergeable pair leaves the batch.  What is left of each is its token count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, shared

NONE = np.int32(2**31 - 1)


class Merges:
    """Ranks and results of a vocabulary's merges, looked up for whole arrays of pairs."""

    def __init__(self, merges: list[tuple[int, int, int]], size: int):
        self.size = size
        table = np.array(merges, np.int64).reshape(-1, 3)
        made: dict[int, int] = {}
        for r, (a, b, c) in enumerate(merges):
            if max(made.get(a, -1), made.get(b, -1)) >= r:
                raise ValueError("a merge stands before the merges that make its parts")
            made.setdefault(c, r)
        keys = table[:, 0] * size + table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.result = table[:, 2].astype(np.int32)
        # An open table: the slot of a key is its product's top bits; buckets hold few keys and are probed one after another.
        self.bits = 18
        self.slots = np.full((1 << self.bits) + 64, -1, np.int64)
        self.slot_rank = np.full((1 << self.bits) + 64, NONE, np.int32)
        self.probes = 1
        for k, r in zip(self.keys.tolist(), self.ranks.tolist(), strict=True):
            s = int(((k * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits))
            n = 1
            while self.slots[s] >= 0:
                s, n = s + 1, n + 1
            self.slots[s], self.slot_rank[s] = k, r
            self.probes = max(self.probes, n)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.slots[at] == keys, self.slot_rank[at], NONE)
        left_over = np.flatnonzero((out == NONE) & (self.slots[at] >= 0))
        for p in range(1, self.probes):
            if not len(left_over):
                break
            s = at[left_over] + p
            found = self.slots[s] == keys[left_over]
            out[left_over[found]] = self.slot_rank[s[found]]
            left_over = left_over[~found & (self.slots[s] >= 0)]
        return out


def merge_batch(merges: Merges, sym: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all sequences one after another, each ending before its entry of ends -> the same once fully merged."""
    n = len(ends)
    lengths = np.diff(ends, prepend=0)
    seq = np.repeat(np.arange(n, dtype=np.int32), lengths)
    sym = sym.astype(np.int32)
    counts = np.zeros(n, np.int64)
    done_sym, done_seq = [], []

    def ranked(s: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.full(len(s), NONE, np.int32)
        if len(s) > 1:
            same = np.flatnonzero(q[:-1] == q[1:])
            out[same] = merges.rank(s[same], s[same + 1])
        return out

    rank = ranked(sym, seq)
    while len(sym):
        first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        low = np.minimum.reduceat(rank, first)
        size = np.diff(first, append=len(sym))
        over = low == NONE
        if over.any():
            gone = np.repeat(over, size)
            done_sym.append(sym[gone])
            done_seq.append(seq[gone])
            counts[seq[first[over]]] = size[over]
            sym, seq, rank = sym[~gone], seq[~gone], rank[~gone]
            if not len(sym):
                break
            low, size = low[~over], size[~over]
        hit = rank == np.repeat(low, size)
        both = hit[1:] & hit[:-1]
        if both.any():  # a run of equal symbols: its first, third, ... pair
            at = np.flatnonzero(hit)
            run = np.cumsum(np.concatenate(([True], np.diff(at) > 1)))
            start = np.flatnonzero(np.concatenate(([True], np.diff(run) > 0)))
            odd = (np.arange(len(at)) - start[run - 1]) % 2 == 1
            hit[at[odd]] = False
        at = np.flatnonzero(hit)
        sym[at] = merges.result[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))  # where the merged symbols stand after compaction
        sym, seq, rank = sym[keep], seq[keep], rank[keep]
        touched = np.concatenate((moved, moved[moved > 0] - 1))
        right = np.minimum(touched + 1, len(sym) - 1)
        ok = (touched + 1 < len(sym)) & (seq[touched] == seq[right])
        fresh = np.full(len(touched), NONE, np.int32)
        fresh[ok] = merges.rank(sym[touched[ok]], sym[right[ok]])
        rank[touched] = fresh
    if done_sym:
        all_seq = np.concatenate(done_seq)
        order = np.argsort(all_seq, kind="stable")
        return np.concatenate(done_sym)[order], np.cumsum(counts)
    return np.zeros(0, np.int32), np.cumsum(counts)


@lru_cache(maxsize=2)
def _count_table(path: str):
    from .bpe import LONG_WORD_BYTES, WordTable, vocabulary

    v = vocabulary(path)

    def fill(words: list[str]) -> list[int]:
        plain, others = v.known_to_python(words)
        parts, counts = v.pre_tokens(plain) if plain else ([], np.zeros(0, np.int64))
        more, more_counts, special = v.library_pre_tokens(others) if others else ([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        parts, counts = parts + more, np.concatenate((counts, more_counts))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        short = size <= LONG_WORD_BYTES
        _, ends = v._encode_batch(parts if short.all() else [p for p in parts if len(p) <= LONG_WORD_BYTES])
        size[short] = np.diff(ends, prepend=0)
        for i in np.flatnonzero(~short):
            size[i] = len(v.encode_long(parts[i]))
        total = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        n = np.diff(total)
        n[len(plain) :] += special
        known = dict(zip(plain + others, n.tolist(), strict=True))
        return [known[w] for w in words]

    return WordTable(fill)


def count_texts(path: str, texts: list[str]) -> list[int]:
    from .bpe import batches, vocabulary

    v, table, out = vocabulary(path), _count_table(path), []
    for part in batches(texts):
        lists = [v.words(t) for t in texts[part]]
        known = table.ensure(lists)
        out += [sum(map(known.__getitem__, words)) for words in lists]
    return out


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in repeats.slices(b, 1 << 20)):
            n = pa.array(count_texts(path, batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(df: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of df(doc_id, text, ...).

    A null text counts as empty: 0 bytes, 0 tokens.  Rows are taken one by one, so repeated rows give repeated results, and
    other columns, whatever their names, are left out.
    """
    shared.prepare(df.sparkSession)
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(_run(path), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
