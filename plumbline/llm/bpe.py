"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round finds the rank of
every pair of neighbours by binary search over the sorted pair keys, takes each
word's lowest rank, and merges its pairs of that rank from left to right, all
words at once.  Words without a mergeable pair leave the array.  Every distinct
word is encoded once per worker and remembered (``Params.cache`` words at most).

A word of over ``Params.long_word`` bytes needs very many rounds, each of which
changes few places.  Such words lie in a flat array of their own, where a round
merges the pairs of the lowest rank over all of them (words don't touch, so each
still sees its own ranks in rising order) and reads only the blocks of the array
that hold that rank, by the lowest rank kept for every block.

Decoding joins the tokens' bytes and reads them as UTF-8, with a replacement
character for what is no UTF-8.

Defined results: null counts as empty and gives no ids; special strings in a
text become their special ids, as the library does by default; repeated rows are
encoded one by one; texts of any length are encoded whole; an empty table gives
an empty result; own columns are kept, but for ``text`` and those named as a
result (n_tokens, ids_sha256, decoded_sha256; ids; decoded), which give way.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_batches

VOCABULARY = "byte_bpe_50k.json"
_BLOCK = 128


@dataclass(frozen=True)
class Params:
    cache: int = 50_000
    long_word: int = 400
    batch_bytes: int = 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter of every byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in rising order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


def _room(array: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """``array`` with room for ``wanted`` values, at least doubled where it grows."""
    if wanted <= len(array):
        return array
    out = np.zeros(max(wanted, 2 * len(array)), array.dtype)
    out[:used] = array[:used]
    return out


class Codec:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str, params: Params = Params()):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, model = byte_letters(), data["model"]
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in data["added_tokens"])])
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.pieces = pieces
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.parts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.params, self.none = params, len(keys)
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.ids, self.count, self.offset, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``self.none`` where it doesn't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray | None] = [None] * len(words)
        flat, long = [], []
        for k, w in enumerate(words):
            (flat if len(w) <= self.params.long_word else long).append(k)
        for k, ids in zip(long, self._merge_long([words[k] for k in long]), strict=True):
            out[k] = ids
        size = np.array([len(words[k]) for k in flat], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words[k] for k in flat), np.uint8)]
        word = np.repeat(np.arange(len(flat)), size)
        rank = np.full(len(sym), self.none)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self.ranks(sym[same], sym[same + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(sym)])
            done = best == self.none
            if done.any():
                for k in np.flatnonzero(done):
                    out[flat[word[first[k]]]] = sym[first[k] : first[k] + count[k]].astype(np.int32)
                stay = np.repeat(~done, count)
                sym, word, rank = sym[stay], word[stay], rank[stay]
                best, count = best[~done], count[~done]
                if not len(sym):
                    break
            hit = (rank == np.repeat(best, count)) & (rank < self.none)
            # Of neighbouring hits (one symbol repeated) every second one merges, from the left.
            at = np.arange(len(sym))
            begins = hit & ~np.r_[False, hit[:-1]]
            since = at - np.maximum.accumulate(np.where(begins, at, 0))
            take = np.flatnonzero(hit & (since % 2 == 0))
            sym[take] = self.made[rank[take]]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[take] = True
            sym, word, rank, changed = sym[keep], word[keep], rank[keep], changed[keep]
            redo = np.flatnonzero(changed | np.r_[changed[1:], False])
            inside = redo[redo + 1 < len(sym)]
            inside = inside[word[inside] == word[inside + 1]]
            rank[redo] = self.none
            rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        return [x if x is not None else np.zeros(0, np.int32) for x in out]

    def _merge_long(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of long words, by rounds over the blocks that hold the lowest rank."""
        if not words:
            return []
        firsts = np.r_[0, np.cumsum([len(w) for w in words])]
        n = int(firsts[-1])
        # Place n stands before and after every word; its symbol makes no pair.
        sym = np.full(n + 1, -1, np.int64)
        sym[:n] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[firsts[1:] - 1] = after[n] = n
        before[firsts[:-1]] = n
        rank = np.full(-(-(n + 1) // _BLOCK) * _BLOCK, self.none, np.int32)
        rank[:n] = self.ranks(sym[:n], sym[after[:n]])
        blocks = rank.reshape(-1, _BLOCK)
        low = blocks.min(1)
        while (best := low.min()) < self.none:
            some = np.flatnonzero(low == best)
            row, column = np.nonzero(blocks[some] == best)
            at = some[row] * _BLOCK + column
            # Of a chain of pairs (one symbol repeated) every second one merges, from the left.
            k = np.arange(len(at))
            begins = np.r_[True, after[at[:-1]] != at[1:]]
            take = at[(k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 0]
            gone = after[take]
            follows = after[gone]
            sym[take], sym[gone] = self.made[best], -1
            after[take], before[follows] = follows, take
            rank[gone] = self.none
            redo = np.concatenate([take, before[take]])
            rank[redo] = self.ranks(sym[redo], sym[after[redo]])
            touched = np.unique(np.concatenate([redo, gone]) // _BLOCK)
            low[touched] = blocks[touched].min(1)
        return [(x := sym[a:b])[x >= 0].astype(np.int32) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]

    def _learn(self, words: list[str]) -> None:
        got = self.merge([w.encode("utf-8") for w in words])
        sizes = np.array([len(x) for x in got], np.int64)
        at, used = len(self.known), self.used
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.count, self.offset = (_room(x, at, at + len(words)) for x in (self.count, self.offset))
        self.ids = _room(self.ids, used, used + int(sizes.sum()))
        self.used = used + int(sizes.sum())
        self.count[at : at + len(words)] = sizes
        self.offset[at : at + len(words)] = used + np.cumsum(sizes) - sizes
        self.ids[used : self.used] = np.concatenate(got)

    def _pieces(self, text: str) -> Iterator[str | int]:
        at = 0
        for m in self.parts.finditer(text) if self.parts else ():
            if m.start() > at:
                yield text[at : m.start()]
            yield self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text; special strings become their ids."""
        split: list[list] = []
        new: dict[str, None] = {}
        if len(self.known) > self.params.cache:
            self._reset()
        for t in texts:
            parts: list = []
            for piece in self._pieces(t or ""):
                if isinstance(piece, int):
                    parts.append(piece)
                else:
                    ws = self.words.findall(piece)
                    new.update(dict.fromkeys(w for w in ws if w not in self.known))
                    parts.append(ws)
            split.append(parts)
        if new:
            self._learn(list(new))
        out = []
        for parts in split:
            got = []
            for p in parts:
                if isinstance(p, int):
                    got.append(np.array([p], np.int32))
                elif p:
                    w = np.fromiter(map(self.known.__getitem__, p), np.int64, len(p))
                    n = self.count[w]
                    ends = np.cumsum(n)
                    got.append(self.ids[np.arange(ends[-1]) + np.repeat(self.offset[w] - ends + n, n)])
            out.append(np.concatenate(got) if got else np.zeros(0, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        n = self.length[ids]
        if not n.sum():
            return ""
        ends = np.cumsum(n)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + n, n)].tobytes().decode("utf-8", "replace")


def by_bytes(texts: pd.Series, limit: int) -> Iterator[list]:
    """Runs of neighbouring texts of about ``limit`` characters at most; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        n = len(t) if t is not None else 0
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def round_trip(docs: DataFrame, vocabulary: str | None = None, params: Params = Params()) -> DataFrame:
    """``docs`` without its text: its other columns, n_tokens, ids_sha256 and decoded_sha256.

    vocabulary: a path that every worker can read; by default the installed file.
    """
    text_batches(docs.sparkSession)
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(vocabulary or public_tokenizers.path(VOCABULARY), params)
        for x in batches:
            rows = []
            for part in by_bytes(x, params.batch_bytes):
                for ids in codec.encode_batch(part):
                    decoded = codec.decode(ids).encode("utf-8")
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=made)
        del codec
        release()

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*made, "text", "_bpe")]
    return docs.select(*keep, run(F.col("text")).alias("_bpe")).select(*keep, "_bpe.*")


def encode(docs: DataFrame, vocabulary: str | None = None, params: Params = Params()) -> DataFrame:
    """``docs`` with the column ids: array<int>."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(vocabulary or public_tokenizers.path(VOCABULARY), params)
        for x in batches:
            yield pd.Series([ids for part in by_bytes(x, params.batch_bytes) for ids in codec.encode_batch(part)])

    return docs.withColumn("ids", run(F.col("text")))


def decode(docs: DataFrame, vocabulary: str | None = None, params: Params = Params()) -> DataFrame:
    """``docs`` with its column ids read back as the column decoded; null ids give an empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(vocabulary or public_tokenizers.path(VOCABULARY), params)
        for x in batches:
            yield pd.Series([codec.decode(np.asarray(ids if ids is not None else [], np.int64)) for ids in x])

    return docs.withColumn("decoded", run(F.col("ids")))
