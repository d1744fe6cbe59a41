"""Byte-pair encoding and decoding by tree concatenation.

White space never enters a token of this vocabulary, so a text is the sequence of its white-space-free words, and a word's
ids depend on the word alone.  Words are encoded in batches (see token_counts.merge_batch) and kept in a bounded table.

A long unsplit word is cut into leaves that are encoded side by side; halves are then joined pairwise, level by level.  A join
re-encodes a window around the cut, doubled until its outermost tokens are those that the halves had there.  Two token lists
that agree on a token on each side of the cut have only pairs that stand side by side in some valid encoding, which makes the
whole list the encoding of the whole word.  A token spells its bytes, so a join needs the tokens alone, not the text.

A long document is cut into pieces, encoded as rows of their own on any executor, a long word's parts among them.  Neighbours see the same few
characters after the nominal cut and choose the same place in them: at white space, or within a run of letters, of digits or of plain signs.
Where the pieces meet, only windows around the cuts are encoded again.  Where those characters offer no such place, the word at
the cut is handed on as text.

Words with characters from U+0250 on are normalized and cut into pre-tokens by the tokenizers library, whose Unicode tables may differ from
Python's; they are encoded here like all others.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, shared
from .token_counts import Merges, merge_batch

#: Unicode White_Space, which the vocabulary's normalizer folds into one space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What str.split() takes for white space besides.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters from here on are normalized by the tokenizers library, whose Unicode tables may differ from Python's.
FIRST_OTHER = "\u0250"
SPECIAL_MARK = "<|"
LEAF_BYTES = 64
#: Words of more bytes are encoded by tree concatenation.
LONG_WORD_BYTES = 256
#: Documents of more characters are encoded in pieces; the place of a cut is sought in so many characters.
PIECE_CHARS = 1 << 16
MARGIN = 256
#: Kinds of cuts: at a space, within a run of one kind of characters, between pre-tokens of one word, elsewhere in a word.
SPACE, INNER, BETWEEN, RAW = 0, 1, 2, 3
#: Entries and characters of a worker's word table; it starts anew beyond either.
TABLE_WORDS, TABLE_CHARS = 100_000, 1 << 21


class Vocabulary:
    """word_bpe files: BPE with an end-of-word suffix, byte level, without a decoder (decoded tokens stand apart by spaces)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or spec["decoder"] is not None:
            raise ValueError(f"{path} isn't a word BPE vocabulary")
        self.path, vocab = path, model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + "</w>"] for s in symbols], np.int32)
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], len(vocab))
        tokens = dict(vocab) | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.tokens[i] = token
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.bytes_of = {ord(s): chr(b) for b, s in enumerate(symbols)}
        back = {s: b for b, s in enumerate(symbols)}
        self.spelling = [bytes(back[c] for c in t.removesuffix("</w>")) if all(c in back for c in t.removesuffix("</w>")) else b"" for t in self.tokens]
        self.ends_word = np.array([t.endswith("</w>") for t in self.tokens])
        # No special token reaches into a run that stands behind so many characters that begin none.
        reach = max((len(t["content"]) for t in spec["added_tokens"]), default=1)
        free = f"[^{''.join(sorted({regex.escape(t['content'][0]) for t in spec['added_tokens']}))}]{{{reach}}}"
        run = r"[\p{L}--[\u1100-\u11ff\ua960-\ua97f\ud7b0-\ud7ffΣ]]{6}|[\-_=*.#~+/\\]{6}"
        self.inner_cut = regex.compile(rf"(?V1)(?<={free})(?={run})")
        self.digits_cut = regex.compile(rf"(?<={free}[0-9])(?=[0-9])")
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+|\n")
        self.splitter = regex.compile(f"[{SPACES}]+")
        self.other = regex.compile(f"[{FIRST_OTHER}-\U0010ffff]|{regex.escape(SPECIAL_MARK)}")
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.path)
            t.no_truncation()
            t.no_padding()
            self._library = t
        return self._library

    def words(self, text: str) -> list[str]:
        """The white-space-free words of a text."""
        if any(c in text for c in SEPARATORS):
            return [w for w in self.splitter.split(text) if w]
        return text.split()

    def pre_tokens(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Of words below FIRST_OTHER: all pre-tokens, and how many each word has."""
        text = "\n".join(words)
        text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        found = self.pattern.findall(text)
        cuts = np.flatnonzero(np.fromiter((p == "\n" for p in found), bool, len(found)))
        counts = np.diff(np.concatenate(([-1], cuts, [len(found)]))) - 1
        return [p.encode() for p in found if p != "\n"], counts

    def library_pre_tokens(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of any words, normalized and cut by the library: all pre-tokens, how many each word has, and its special tokens besides."""
        normalize, cut = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        parts, counts, special = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            between = self.special.split(w)
            found = [p.translate(self.bytes_of).encode("latin-1") for s in between if s for p, _ in cut(normalize(s))]
            parts += found
            counts[i], special[i] = len(found), len(between) - 1
        return parts, counts, special

    def known_to_python(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Words that this module encodes, and those left to the library."""
        if not self.other.search("\n".join(words)):
            return words, []
        search = self.other.search
        return [w for w in words if not search(w)], [w for w in words if search(w)]

    def symbols(self, piece: bytes, last: bool = True) -> np.ndarray:
        raw = np.frombuffer(piece, np.uint8)
        out = self.inner[raw]
        if last and len(raw):
            out[-1] = self.final[raw[-1]]
        return out

    def cut_words(self, words: list[str]) -> tuple[list[bytes | int], list[int], bool]:
        """Pre-tokens of all words, one after another, how many each has, and whether any is a special token, given by its id."""
        plain, others = self.known_to_python(words)
        own, n = self.pre_tokens(plain) if plain else ([], np.zeros(0, np.int64))
        if not others:
            return own, n.tolist(), False
        normalize, cut = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        ends = iter(np.cumsum(n).tolist())
        parts, counts, at, search = [], [], 0, self.other.search
        for w in words:
            before = len(parts)
            if search(w):
                end = 0
                for m in [*self.special.finditer(w), None]:
                    if between := w[end : m.start() if m else None]:
                        parts += [p.translate(self.bytes_of).encode("latin-1") for p, _ in cut(normalize(between))]
                    if m:
                        parts.append(self.special_ids[m[0]])
                        end = m.end()
            else:
                stop = next(ends)
                parts += own[at:stop]
                at = stop
            counts.append(len(parts) - before)
        return parts, counts, True

    def encode_parts(self, parts: list[bytes | int]) -> list[np.ndarray]:
        """Ids of each pre-token: one batch for all short ones, a tree for each long one."""
        short = [p for p in parts if not isinstance(p, int) and len(p) <= LONG_WORD_BYTES]
        ids, ends = self._encode_batch(short)
        found = iter(np.split(ids, ends[:-1])) if len(ends) else iter(())
        return [np.array([p], np.int32) if isinstance(p, int) else next(found) if len(p) <= LONG_WORD_BYTES else self.encode_long(p) for p in parts]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        parts, counts, mixed = self.cut_words(words)
        if mixed or max(map(len, parts), default=0) > LONG_WORD_BYTES:
            pieces = self.encode_parts(parts)
            ids, ends = (np.concatenate(pieces), np.cumsum([len(x) for x in pieces])) if pieces else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        else:
            ids, ends = self._encode_batch(parts)
        raw = ids.astype("<u4").tobytes()
        at = 4 * np.concatenate(([0], ends))
        edge = at[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))].tolist()
        return [raw[a:b] for a, b in zip(edge, edge[1:], strict=False)]

    def _encode_batch(self, pieces: list[bytes], final: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and where each piece's end."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        sym = self.inner[raw]
        last = ends - 1 if final is None else (ends - 1)[final]
        sym[last] = self.final[raw[last]]
        return merge_batch(self.merges, sym, ends)

    def encode_long(self, piece: bytes, ends: bool = True) -> np.ndarray:
        """Tree concatenation of a pre-token's leaves; without ends, the pre-token goes on behind the piece."""
        leaves = [piece[i : i + LEAF_BYTES] for i in range(0, len(piece), LEAF_BYTES)]
        final = np.zeros(len(leaves), bool)
        final[-1] = ends
        ids, stops = self._encode_batch(leaves, final)
        level = np.split(ids, stops[:-1])
        while len(level) > 1:
            joined = [self.join(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = joined + level[len(level) - len(level) % 2 :]
        return level[0]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The symbols that tokens are made of."""
        out = []
        for i in ids.tolist():
            raw = self.inner[np.frombuffer(self.spelling[i], np.uint8)]
            if self.ends_word[i]:
                raw[-1] = self.final[self.spelling[i][-1]]
            out.append(raw)
        return np.concatenate(out)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two neighbouring parts of a pre-token: the window around the cut grows until both sides agree."""
        k = 2
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            sym = self.spell(np.concatenate((left[len(left) - a :], right[:b])))
            window, _ = merge_batch(self.merges, sym, np.array([len(sym)]))
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return np.concatenate((left[: len(left) - a], window, right[b:]))
            k *= 2

    def decode(self, ids: bytes) -> str:
        """As the library decodes without skipping special tokens: this vocabulary has no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordTable:
    """word -> value, filled in batches and started anew beyond a number of entries or characters; memory stays bounded."""

    def __init__(self, fill):
        self.fill, self.known, self.chars = fill, {}, 0

    def ensure(self, lists: list[list[str]]) -> dict:
        if len(self.known) > TABLE_WORDS or self.chars > TABLE_CHARS:
            self.known, self.chars = {}, 0
        known = self.known
        missing = {w for words in lists for w in words if w not in known}
        if missing:
            missing = list(missing)
            self.chars += sum(map(len, missing))
            known.update(zip(missing, self.fill(missing), strict=True))
        return known


@lru_cache(maxsize=2)
def _id_table(path: str) -> WordTable:
    v = vocabulary(path)
    return WordTable(v.encode_words)


#: Texts that share one look-up of missing words, in characters; a slice of a batch, in bytes.
BATCH_CHARS, SLICE_BYTES = 1_000_000, 1 << 20


def batches(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""
    v, table, out = vocabulary(path), _id_table(path), []
    for part in batches(texts):
        lists = [v.words(t) for t in texts[part]]
        known = table.ensure(lists)
        out += [b"".join(map(known.__getitem__, words)) for words in lists]
    return out


def _encode_whole(path: str, decode: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        # A slice of texts at a time becomes Python objects, not a whole batch.
        for batch in (x for b in frames for x in repeats.slices(b, SLICE_BYTES)):
            ids = encode_texts(path, batch.column("text").to_pylist())
            decoded = [v.decode(x) if decode else None for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def find_cut(v: Vocabulary, margin: str) -> tuple[int, int]:
    """Where the characters after a nominal cut are cut, and the kind of cut: both neighbours find the same."""
    found = [(m.start() + shift, kind) for r, shift, kind in ((v.splitter, 0, SPACE), (v.inner_cut, 4, INNER), (v.digits_cut, 0, BETWEEN)) if (m := r.search(margin))]
    return min(found, default=(0, RAW))


@dataclass
class Fragment:
    """Ids of a part of a text.  n_first and n_last are those of a first or last pre-token that is cut; one: it is a single pre-token cut on both sides."""

    ids: np.ndarray
    n_first: int = 0
    n_last: int = 0
    one: bool = False


def encode_fragment(path: str, words: list[str], left: int, right: int) -> Fragment:
    """Of words whose first begins at a cut of kind left and whose last ends at one of kind right."""
    if len(words) > 1:
        a, b = encode_fragment(path, words[:1], left, SPACE), encode_fragment(path, words[-1:], SPACE, right)
        inner = encode_fragment(path, [" ".join(words[1:-1])], SPACE, SPACE)
        return Fragment(np.concatenate((a.ids, inner.ids, b.ids)), a.n_first, b.n_last)
    if not words or INNER not in (left, right):
        return Fragment(np.frombuffer(encode_texts(path, ["".join(words)])[0], "<u4").astype(np.int32))
    v = vocabulary(path)
    parts, _, _ = v.cut_words(words)
    ids = v.encode_parts(parts[:-1]) + ([v.encode_long(parts[-1], False)] if right == INNER else v.encode_parts(parts[-1:]))
    return Fragment(np.concatenate(ids), len(ids[0]) if left == INNER else 0, len(ids[-1]) if right == INNER else 0, len(ids) == 1 and left == right == INNER)


def _encode_pieces(path: str, piece_chars: int, margin: int):
    """Of each piece: its words' ids.  Words that touch a cut of kind RAW are handed on as text: head is the first, tail the last; head without
    tail is the piece's only word, or the end of one."""

    def piece(v: Vocabulary, part: int, text: str) -> tuple:
        a, left = find_cut(v, text[:margin]) if part else (0, SPACE)
        b, right = find_cut(v, text[piece_chars:]) if len(text) > piece_chars else (0, SPACE)
        own = text[a : piece_chars + b] if len(text) > piece_chars else text[a:]
        words = [w for w in v.splitter.split(own) if w]
        touches = bool(own) and not v.splitter.match(own[0]), bool(own) and not v.splitter.match(own[-1])
        head = tail = None
        if RAW in (left, right) and len(words) == 1 and all(touches):
            head = words.pop()
        else:
            if left == RAW:
                head = words.pop(0) if touches[0] else ""
            if right == RAW:
                tail = words.pop() if touches[1] else ""
        f = encode_fragment(path, words, left, right)
        return left, right, head, f.ids.astype("<u4").tobytes(), f.n_first, f.n_last, f.one, tail

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for df in frames:
            rows = [(digest, part, *piece(v, part, text)) for digest, part, text in df[["digest", "part", "text"]].itertuples(index=False)]
            if rows:
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])

    return run


PIECES = "digest string, part int, left int, right int, head string, ids binary, n_first int, n_last int, one boolean, tail string"


def _join_pieces(path: str, decode: bool):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        v = vocabulary(path)
        out: list[np.ndarray] = []
        cut: np.ndarray | None = None  # ids of a pre-token that goes on in the next piece
        text, text_left = None, SPACE  # a word at a RAW cut, and the kind of cut it begins at

        def add(f: Fragment, left: int, right: int) -> None:
            nonlocal cut
            ids = f.ids
            if left == INNER:
                joined = v.join(cut, ids[: f.n_first])
                if f.one:
                    cut = joined
                    return
                out.append(joined)
                ids = ids[f.n_first :]
            cut = ids[len(ids) - f.n_last :] if right == INNER else None
            out.append(ids[: len(ids) - f.n_last] if right == INNER else ids)

        for _, _, left, right, head, raw, n_first, n_last, one, tail in df.sort_values("part").itertuples(index=False):
            body = Fragment(np.frombuffer(raw, "<u4").astype(np.int32), n_first, n_last, one)
            if head is not None and tail is None and not len(body.ids):
                text, text_left = (text or "") + head, text_left if text is not None else left
                if right != RAW:
                    add(encode_fragment(path, [text] if text else [], text_left, right), text_left, right)
                    text = None
                continue
            if head is not None:
                add(encode_fragment(path, [text + head] if text + head else [], text_left, SPACE), text_left, SPACE)
                text = None
                add(body, SPACE, right)
            else:
                add(body, left, right)
            if tail is not None:
                text, text_left = tail, SPACE
        if text:
            add(encode_fragment(path, [text], text_left, SPACE), text_left, SPACE)
        ids = np.concatenate(out).astype("<u4").tobytes() if out else b""
        return pd.DataFrame({"digest": df["digest"].iloc[:1], "ids": [ids], "decoded": [v.decode(ids) if decode else None]})

    return run


SCHEMA = "doc_id long, ids binary, decoded string"


def encode(df: DataFrame, path: str, decode: bool = True, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens and decoded of every row of df(doc_id, text, ...).

    A null text counts as empty: no ids, and "" decoded.  Repeated rows give repeated results, and a null doc_id stays null.  Other
    columns are left out.
    """
    shared.prepare(df.sparkSession)
    margin = min(MARGIN, piece_chars // 2)
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.filter(F.length("text") <= piece_chars).mapInArrow(_encode_whole(path, decode), SCHEMA)
    # Long texts are known by their digest: equal ones are encoded once, and rows find their ids by it whatever their doc_id.
    long = rows.filter(F.length("text") > piece_chars).withColumn("digest", F.sha2("text", 256))
    parts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece_chars).cast("int"))
    cut = long.select("digest", "text", F.explode(parts).alias("part"))
    cut = cut.select("digest", "part", F.substring("text", F.col("part") * piece_chars + 1, F.lit(piece_chars + margin)).alias("text"))
    pieces = cut.dropDuplicates(["digest", "part"]).mapInPandas(_encode_pieces(path, piece_chars, margin), PIECES)
    joined = pieces.groupBy("digest").applyInPandas(_join_pieces(path, decode), "digest string, ids binary, decoded string")
    joined = long.select("doc_id", "digest").join(joined, "digest").select("doc_id", "ids", "decoded")
    return whole.unionByName(joined).select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "decoded")
