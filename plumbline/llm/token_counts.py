"""Token counts: batch encoding in Arrow functions that gives lengths only.

Arrow batches hold a few megabytes.  Their texts, those longer than
``Params.split_bytes`` cut into segments, are sorted by size and dealt into
encoding batches of nearly equal bytes, ``Params.batch_bytes`` at most (or one
segment); a text's segments are added up.

Segments of a byte-level vocabulary end where no pre-token can go on, whatever
the text: before white space, and before punctuation that follows a letter or
digit of the alphabets below.  A pre-token is one run of letters, of digits, or
of other signs, with at most one space in front; only a contraction mixes them,
and it starts with its sign.  Neither place lies within a special string: those
hold no white space, and their signs are not among the punctuation.  This holds
for texts in any script that has spaces or punctuation; a run without either
stays whole, and so does every text of another vocabulary (sentencepiece, or a
JSON file with a normaliser or another pre-tokeniser).

Defined results: null counts as empty, with 0 bytes and 0 tokens; special
strings in a text count as the library takes them by default; texts of any
length are counted whole; repeated rows are counted one by one; an empty table
gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

# Letters and digits that every version of Unicode calls so, and punctuation likewise.
_LETTERS = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0905-\u0939\u0e01-\u0e30\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_SIGNS = ".,;:!?()\u3001\u3002\u300c\u300d\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
_SAFE = re.compile(f"(?<=[{_LETTERS}{_SIGNS}])(?=[ \n\r\t])|(?<=[{_LETTERS}])(?=[{_SIGNS}])")


@dataclass(frozen=True)
class Params:
    vocabulary: str = "byte_bpe_50k.json"
    limit: int = 1024
    batch_bytes: int = 1_000_000
    split_bytes: int = 100_000


def segments(text: str, size: int) -> list[str]:
    """Cuts ``text`` at the first safe place after every ``size`` bytes or fewer (counted as if all characters were as wide as the mean)."""
    wide = len(text.encode("utf-8", "replace")) / max(1, len(text))
    step, out, at = max(1, int(size / max(1.0, wide))), [], 0
    while len(text) - at > step:
        m = _SAFE.search(text, at + step)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def splits_safely(path: str) -> bool:
    """Whether the vocabulary cuts words as ``segments`` takes for granted."""
    if not path.endswith(".json"):
        return False
    with open(path) as f:
        v = json.load(f)
    pre = v.get("pre_tokenizer") or {}
    plain = all(not re.search(rf"\s|[{_SIGNS}]", t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in v.get("added_tokens", ()))
    return plain and v.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def counter(path: str, params: Params) -> Callable[[list[str]], list[int]]:
    """Gives the number of tokens of each text of a batch."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's to share out
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def balanced(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Deals items into as few batches of ``most`` bytes as hold them all, the largest first into the lightest."""
    n = max(1, -(-int(sizes.sum()) // max(1, most)))
    heap, parts = [(0, k) for k in range(n)], [[] for _ in range(n)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        held, k = heap[0]
        heapq.heapreplace(heap, (held + int(sizes[i]), k))
        parts[k].append(i)
    return [np.array(p, np.int64) for p in parts if p]


def lengths(texts: list[str | None], count: Callable[[list[str]], list[int]], params: Params, splits: bool) -> np.ndarray:
    """Token counts of ``texts``, in batches balanced by bytes."""
    parts, rows = [], []
    for k, t in enumerate(texts):
        own = segments(t, params.split_bytes) if t and splits else [t] if t else []
        parts += own
        rows += [k] * len(own)
    total = np.zeros(len(texts), np.int64)
    sizes = np.array([len(p.encode("utf-8", "replace")) for p in parts], np.int64)
    for batch in balanced(sizes, params.batch_bytes):
        np.add.at(total, np.array(rows)[batch], count([parts[i] for i in batch]))
    return total


def count_tokens(docs: DataFrame, params: Params = Params(), path: str | None = None) -> DataFrame:
    """``docs`` without its text: its other columns, n_bytes, n_tokens and over_limit."""
    path = path or public_tokenizers.path(params.vocabulary)
    splits = splits_safely(path)
    text_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path, params)
        for x in batches:
            yield pd.Series(lengths(list(x), count, params, splits))

    made = ("n_bytes", "n_tokens", "over_limit")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*made, "text")]
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    df = docs.select(*keep, size.alias("n_bytes"), run(F.col("text")).alias("n_tokens"))
    return df.withColumn("over_limit", F.col("n_tokens") > params.limit)
