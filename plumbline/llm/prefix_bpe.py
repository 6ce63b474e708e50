"""Byte-level BPE by a table of byte prefixes.

In an exact encoding every two neighbouring tokens are what the merges make of
their joined bytes, and the encoding of a prefix is the encoding of a shorter
prefix and one more token.  So each prefix of a word has one valid last token,
and a table of them holds the encodings of all prefixes: the last token of a
prefix is the one that ends there and fits behind the last token of what precedes
it.  An automaton of the tokens names those that end at a place.

Whether two tokens fit is settled at the seam alone: the left one's parts at
their right edge and the right one's parts at their left edge come about in the
order of their ranks, and no pair across the seam may be due before either side
moves on (of equal ranks the left place merges first).

A table grows with what is appended, and after an edit only its part from the
edit up to where it agrees with the old table again is made anew
(``Encoding``, ``edit``).  Time is in proportion to the bytes, however long a
word is.

Defined results: null counts as empty and gives no ids; special strings in a text
are ordinary text; a word that is a token as a whole is that token, even if no
merges lead to it; repeated rows are encoded one by one; texts of any length are
encoded whole; an empty table gives an empty result; own columns are kept, but for
``text`` in ``round_trip`` and those named as a result (n_tokens, ids_sha256,
decoded_sha256; ids, prefixes; decoded), which give way.  An id beyond the
vocabulary can't be decoded and is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, _room, by_bytes
from .common import release, text_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@dataclass(frozen=True)
class Params:
    cache: int = 200_000
    pairs: int = 1_000_000
    batch_bytes: int = 1_000_000


def _ranges(points: list[int]) -> str:
    """Rising code points as the inside of a character class."""
    ends = np.flatnonzero(np.diff(points, append=-1) != 1) if points else []
    begins = [0, *(e + 1 for e in ends[:-1])]
    return "".join(f"{chr(points[a])}-{chr(points[b])}" for a, b in zip(begins, ends, strict=True)) if points else ""


#: The library's pattern over ASCII texts, for the quicker ``re``; its own white space would take in \\x1C to \\x1F.
_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


class Words:
    """The library's word pattern.

    ``regex`` may know letters and digits that the library's own Unicode tables
    don't have yet.  Of those that Python's tables lack too, the library is asked
    which it takes for such, by merges that no seam between words lets happen.
    """

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        ranks = {bytes([k]): k for k in range(256)} | {bytes([k]) + c: 256 * n + k for n, c in ((1, b"b"), (2, b"1")) for k in range(256)}
        asked = tiktoken.Encoding("seams", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        late = {}
        for kind, c in (("L", "b"), ("N", "1")):
            own = (x for x in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(x) == "Cn")
            late[kind] = _ranges([ord(x) for x in own if asked.encode_ordinary(x + c)[-1] < 256])
        self.usual, self.late = regex.compile(pattern), None
        self.plain = re.compile(_ASCII) if pattern == public_tokenizers.PATTERN else None
        if any(late.values()):
            self.late = np.zeros(0x110000, bool)
            self.late[[ord(x) for x in regex.findall("[" + "".join(late.values()) + "]", every)]] = True
            for kind, own in late.items():
                if own:
                    pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{own}]]")
            self.strict = regex.compile(pattern, regex.V1)

    def _of(self, text: str):
        if text.isascii():
            return self.plain or self.usual
        return self.strict if self.late is not None and self.late[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any() else self.usual

    def findall(self, text: str) -> list[str]:
        return self._of(text).findall(text)

    def finditer(self, text: str, at: int = 0):
        return self._of(text).finditer(text, at)


def shared_starts(words: list[bytes], reach: int = 32) -> list[int]:
    """How many bytes each word begins with like the one before it, ``reach`` at most."""
    if not words:
        return []
    size = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), reach)
    table = np.array([w[:reach] for w in words], f"S{reach}").view(np.uint8).reshape(-1, reach)
    differ = np.c_[table[1:] != table[:-1], np.ones(len(words) - 1, bool)]
    return [0, *np.minimum(differ.argmax(1), np.minimum(size[1:], size[:-1])).tolist()]


class Numbers(dict):
    """Words by number; one that is new takes the next number and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = k = len(self)
        return k


class PrefixCodec(Codec):
    """A byte-level vocabulary of ranks; the batches and the word cache are those of ``Codec``."""

    def __init__(self, path: str, params: Params = Params()):
        with open(path, "rb") as f:
            self.token = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.piece = {i: b for b, i in self.token.items()}
        self.longest = max(map(len, self.token))
        self.words, self.parts, self.special, self.params = Words(), None, {}, params
        self.length = np.zeros(1 + max(self.piece), np.int64)
        for i, b in self.piece.items():
            self.length[i] = len(b)
        self.size = self.length.tolist()
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.piece[i] for i in sorted(self.piece)), np.uint8)
        self.pair = {x << 32 | y: t for b, t in self.token.items() for k in range(1, len(b)) if (x := self.token.get(b[:k])) is not None and (y := self.token.get(b[k:])) is not None}
        self.known: Numbers = Numbers()
        self._reset()
        self._parts()
        self._trie()
        self.fit: dict[int, bool] = {}
        self.jump: dict[int, int] = {}

    def _parts(self) -> None:
        """For every token that merges lead to, its parts at the left and at the right edge, rising."""
        self.left: dict[int, tuple] = {}
        self.right: dict[int, tuple] = {}
        unmade = []
        for t, b in sorted(self.piece.items()):
            if len(b) == 1:
                self.left[t] = self.right[t] = (t,)
        for t, b in sorted(self.piece.items()):
            for k in range(1, len(b)):
                x, y = self.token.get(b[:k]), self.token.get(b[k:])
                if x in self.left and y in self.left and self._fits(x, y, t):
                    self.left[t], self.right[t] = (*self.left[x], t), (*self.right[y], t)
                    break
            else:
                if len(b) > 1:
                    unmade.append(b)
        if odd := [b for b in unmade if len(self._merged(b)) == 1]:
            raise ValueError(f"tokens made by merges of falling rank, such as {odd[0]!r}, are not supported")

    def _merged(self, word: bytes) -> list[bytes]:
        """The plain merges, for the few tokens without parts."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while pairs := [(self.token[a + b], k) for k, (a, b) in enumerate(pairwise(parts)) if a + b in self.token]:
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _fits(self, x: int, y: int, limit: float = float("inf")) -> bool:
        """Whether merges of a rank below ``limit`` leave tokens x and y side by side."""
        right, left, i, j = self.right[x], self.left[y], 0, 0
        while True:
            up_x = right[i + 1] if i + 1 < len(right) else limit
            up_y = left[j + 1] if j + 1 < len(left) else limit
            across = self.pair.get(right[i] << 32 | left[j], limit)
            if across < up_x and across <= up_y:
                return False
            if up_x == limit and up_y == limit:
                return True
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def _trie(self) -> None:
        """Automaton of the tokens that merges lead to: steps by (node, byte), where to go on from a node without the step, and the tokens that end at a node with their lengths, longest first."""
        self.step: dict[int, int] = {}
        own, parents = [-1], [(0, 0)]
        for t in self.left:
            node = 0
            for c in self.piece[t]:
                key = node << 8 | c
                node = self.step.get(key, 0)
                if not node:
                    node = self.step[key] = len(own)
                    own.append(-1)
                    parents.append((key >> 8, c))
            own[node] = t
        self.fall, self.ends, depth = [0] * len(own), [()] * len(own), [0] * len(own)
        for node in range(1, len(own)):
            depth[node] = depth[parents[node][0]] + 1
        for node in np.argsort(depth, kind="stable")[1:].tolist():
            up, c = parents[node]
            self.fall[node] = self._next(self.fall[up], c) if up else 0
            rest = self.ends[self.fall[node]]
            self.ends[node] = ((own[node], depth[node]), *rest) if own[node] >= 0 else rest

    def _next(self, node: int, c: int) -> int:
        step, fall = self.step, self.fall
        while True:
            there = step.get(node << 8 | c, 0)
            if there or not node:
                return there
            node = fall[node]

    def extend(self, word: bytes, last: list[int], upto: int | None = None, nodes: list[int] | None = None) -> None:
        """Grows ``last``, the valid last tokens of the word's first prefixes, to the first ``upto`` bytes, or all.

        nodes: the automaton's nodes at the same prefixes, which grow along; without
        them the bytes that the longest token reaches back are read again.
        """
        ends, fit, following, jump, get, put = self.ends, self.fit, self._next, self.jump.get, self.fit.get, last.append
        if len(fit) > self.params.pairs:
            fit.clear()
        if len(self.jump) > self.params.pairs:
            self.jump.clear()
        begin, node, at = len(last), 0, len(last)
        if nodes is None:
            nodes = []
            for c in word[max(0, begin - self.longest) : begin]:
                node = following(node, c)
        elif nodes:
            node = nodes[-1]
        visit = nodes.append
        for c in word[begin:upto]:
            there = jump(node << 8 | c)
            if there is None:
                there = self.jump[node << 8 | c] = following(node, c)
            node = there
            visit(node)
            at += 1
            for t, n in ends[node]:
                if n == at:
                    break
                key = last[at - n - 1] << 32 | t
                ok = get(key)
                if ok is None:
                    ok = fit[key] = self._fits(last[at - n - 1], t)
                if ok:
                    break
            put(t)

    def back(self, word: bytes, last: list[int]) -> list[int]:
        """The ids of a word from its table."""
        if (whole := self.token.get(word)) is not None:
            return [whole]
        out, at, size = [], len(last), self.size
        while at:
            t = last[at - 1]
            out.append(t)
            at -= size[t]
        return out[::-1]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word.  Words go in their order as bytes, and each grows the table of the one before from where they part."""
        whole = self.token.get
        out = [[t] if (t := whole(w)) is not None else [] for w in words]
        order = sorted((k for k, x in enumerate(out) if not x), key=words.__getitem__)
        own = [words[k] for k in order]
        last: list[int] = []
        nodes: list[int] = []
        for k, w, same in zip(order, own, shared_starts(own), strict=True):
            del last[same:], nodes[same:]
            self.extend(w, last, None, nodes)
            out[k] = self.back(w, last)
        return out

    def _learn(self, words: list[str]) -> None:
        """Appends the ids of the words that were numbered last."""
        got = self.merge([w.encode() for w in words])
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        at, used, more = len(self.known) - len(words), self.used, int(sizes.sum())
        self.count, self.offset = (_room(x, at, at + len(words)) for x in (self.count, self.offset))
        self.ids = _room(self.ids, used, used + more)
        self.used = used + more
        self.count[at : at + len(words)] = sizes
        self.offset[at : at + len(words)] = used + np.cumsum(sizes) - sizes
        self.ids[used : self.used] = np.fromiter(chain.from_iterable(got), np.int32, more)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text; there are no special strings."""
        if len(self.known) > self.params.cache:
            self._reset()
        self.known.new, number, split = [], self.known.__getitem__, []
        for t in texts:
            ws = self.words.findall(t) if t else []
            split.append(np.fromiter(map(number, ws), np.int64, len(ws)))
        if self.known.new:
            self._learn(self.known.new)
        out = []
        for w in split:
            n = self.count[w]
            ends = np.cumsum(n)
            out.append(self.ids[np.arange(ends[-1] if len(w) else 0) + np.repeat(self.offset[w] - ends + n, n)])
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        if not n.sum():
            return b""
        ends = np.cumsum(n)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + n, n)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(path: str, params: Params) -> PrefixCodec:
    """One codec for all tasks of a worker; its caches have the bounds of ``params``."""
    return PrefixCodec(path, params)


class Encoding:
    """A text with the tables of its words, which takes appends and edits."""

    def __init__(self, codec: PrefixCodec, text: str = "", prefixes: list[int] | None = None):
        self.codec, self.text, self.made = codec, "", 0
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        if prefixes is None:
            self.edit(0, 0, text)
            return
        at = 0
        for m in codec.words.finditer(text):
            n = len(m[0].encode())
            self.starts.append(m.start())
            self.tables.append(list(prefixes[at : at + n]))
            at += n
        if at != len(prefixes):
            raise ValueError("the prefixes are those of another text")
        self.text = text

    def append(self, text: str) -> None:
        self.edit(len(self.text), 0, text)

    def edit(self, at: int, removed: int, added: str) -> None:
        """Puts ``added`` in the place of ``removed`` characters from ``at`` on.

        A match of the word pattern looks at two characters past its end at most, or
        three past its start; words before that stay as they are, and so do those
        behind the edit from the first on that begins where an old one did.
        """
        old, starts, tables = self.text, self.starts, self.tables
        at = min(max(at, 0), len(old))
        removed = min(max(removed, 0), len(old) - at)
        self.text = text = old[:at] + added + old[at + removed :]
        ends = [*starts[1:], len(old)]
        keep = 0
        while keep < len(starts) and max(ends[keep] + 2, starts[keep] + 3) <= at:
            keep += 1
        shift, tail = len(added) - removed, {s: k for k, s in enumerate(starts) if s >= at + removed}
        before = {s: k for k, s in enumerate(starts) if k >= keep}
        new_starts, new_tables, rest, self.made = starts[:keep], tables[:keep], len(starts), 0
        for m in self.codec.words.finditer(text, starts[keep] if keep < len(starts) else len(old) if keep else 0):
            if m.start() >= at + len(added) and m.start() - shift in tail:
                rest = tail[m.start() - shift]
                break
            new_starts.append(m.start())
            k = before.get(m.start())
            word, was, table = m[0].encode(), b"", []
            if k is not None:
                was, table = old[starts[k] : ends[k]].encode(), tables[k]
            new_tables.append(self._again(word, was, table))
        self.starts = new_starts + [s + shift for s in starts[rest:]]
        self.tables = new_tables + tables[rest:]

    def _again(self, word: bytes, was: bytes, old: list[int]) -> list[int]:
        """The table of ``word`` with what still holds of the old one of ``was``."""
        same = next((i for i, (a, b) in enumerate(zip(word, was, strict=False)) if a != b), min(len(word), len(was)))
        tail = next((i for i, (a, b) in enumerate(zip(reversed(word[same:]), reversed(was[same:]), strict=False)) if a != b), min(len(word), len(was)) - same)
        last, shift, reach = old[:same], len(word) - len(was), self.codec.longest
        while len(last) < len(word):
            upto = min(len(word), max(len(last), len(word) - tail) + reach)
            self.made += upto - len(last)
            self.codec.extend(word, last, upto)
            # As many alike entries as the longest token reaches back, over the same bytes: all further ones are alike.
            if upto - reach >= len(word) - tail and upto - shift >= reach and last[upto - reach :] == old[upto - reach - shift : upto - shift]:
                last += old[upto - shift :]
        return last

    @property
    def prefixes(self) -> list[int]:
        return list(chain.from_iterable(self.tables))

    @property
    def ids(self) -> list[int]:
        words = (self.text[a:b].encode() for a, b in pairwise([*self.starts, len(self.text)]))
        return list(chain.from_iterable(map(self.codec.back, words, self.tables)))


def _path(vocabulary: str | None) -> str:
    return vocabulary or public_tokenizers.path(VOCABULARY)


def round_trip(docs: DataFrame, vocabulary: str | None = None, params: Params = Params()) -> DataFrame:
    """``docs`` without its text: its other columns, n_tokens, ids_sha256 and decoded_sha256.

    vocabulary: a path that every worker can read; by default the installed file.
    """
    text_batches(docs.sparkSession)
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(_path(vocabulary), params)
        for x in batches:
            rows = []
            for part in by_bytes(x, params.batch_bytes):
                for ids in codec.encode_batch(part):
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode_bytes(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=made)
        release()

    own = [f"own_{i}" for i, c in enumerate(docs.columns) if c not in (*made, "text")]
    keep = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns) if c not in (*made, "text")]
    names = [c for c in docs.columns if c not in (*made, "text")]
    return docs.select(*keep, run(F.col("text")).alias("made")).select(*(F.col(o).alias(c) for o, c in zip(own, names, strict=True)), "made.*")


def encode(docs: DataFrame, vocabulary: str | None = None, params: Params = Params()) -> DataFrame:
    """``docs`` with the columns ids and prefixes (the valid last token of every byte prefix of every word): array<int>."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("ids array<int>, prefixes array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(_path(vocabulary), params)
        for x in batches:
            made = [Encoding(codec, t or "") for t in x]
            yield pd.DataFrame({"ids": [e.ids for e in made], "prefixes": [e.prefixes for e in made]})

    names = [c for c in docs.columns if c not in ("ids", "prefixes")]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("own"), run(F.col("text")).alias("made"))
    return out.select("own.*", "made.ids", "made.prefixes")


def edit(encoded: DataFrame, vocabulary: str | None = None, params: Params = Params()) -> DataFrame:
    """``encoded`` (text, prefixes and, for each row, at, removed, added) after its edits: text, ids and prefixes anew.

    Characters count from 0.  A null ``at`` appends; a null ``removed`` removes
    nothing; a null ``added`` adds nothing.  Null prefixes are made first.
    """
    text_batches(encoded.sparkSession)

    @F.pandas_udf("text string, ids array<int>, prefixes array<int>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        codec = _codec(_path(vocabulary), params)
        for columns in batches:
            made = []
            for text, prefixes, at, removed, added in zip(*columns, strict=True):
                e = Encoding(codec, text or "", None if prefixes is None else prefixes)
                e.edit(len(e.text) if pd.isna(at) else int(at), 0 if pd.isna(removed) else int(removed), added or "")
                made.append((e.text, e.ids, e.prefixes))
            yield pd.DataFrame(made, columns=["text", "ids", "prefixes"])

    names = [c for c in encoded.columns if c not in ("text", "ids", "prefixes")]
    args = [F.col(c) for c in ("text", "prefixes", "at", "removed", "added")]
    out = encoded.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("own"), run(*args).alias("made"))
    return out.select("own.*", "made.text", "made.ids", "made.prefixes")


def decode(encoded: DataFrame, vocabulary: str | None = None, params: Params = Params()) -> DataFrame:
    """``encoded`` with its column ids read back as the column decoded; null ids give an empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(_path(vocabulary), params)
        for x in batches:
            yield pd.Series([codec.decode(np.asarray(ids if ids is not None else [], np.int64)) for ids in x])

    return encoded.withColumn("decoded", run(F.col("ids")))
