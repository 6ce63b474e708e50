"""Prefix tables against the tiktoken library: encoding, decoding, appends and edits."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import prefix_bpe

POOL = ["a", "b", "the ", " ", "'", "'re", "\n", "é", "中", "ñ", "1", "22", " in", "ing", "aaaa", "😀", "<|endoftext|>", "\x1c", " ", "зд", "ลา", "ab" * 5, "  ", "s", "\x00"]


@pytest.fixture(scope="module")
def codec():
    return prefix_bpe.PrefixCodec(public_tokenizers.path(prefix_bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.token, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(POOL), st.text(max_size=3)), max_size=30).map("".join))
def test_ids_are_the_librarys(codec, library, text):
    text = text.encode("utf-8", "replace").decode()
    (ids,) = codec.encode_batch([text])
    assert ids.tolist() == library.encode_ordinary(text) and codec.decode_bytes(ids) == text.encode()


def test_every_code_point(codec, library):
    chars = [chr(i) for i in range(0x40000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}b {c}{c}1{c} '{c} \n{c}" for c in chars[i : i + 50]) for i in range(0, len(chars), 50)]
    assert [x.tolist() for x in codec.encode_batch(texts)] == [library.encode_ordinary(t) for t in texts]


def test_prefixes_hold_the_encoding_of_every_prefix(codec, library):
    word = "Donaudampfschifffahrtsgesellschaft"
    e = prefix_bpe.Encoding(codec, word)
    for n in range(1, len(word) + 1):
        assert e.prefixes[n - 1] == library.encode_ordinary(word[:n])[-1] or word[:n].encode() in codec.token


def test_edits(codec, library):
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice(POOL) for _ in range(rng.randint(0, n)))
    for _ in range(400):
        e = prefix_bpe.Encoding(codec, some(30))
        for _ in range(4):
            e.edit(rng.randint(0, len(e.text)), rng.choice([0, 0, 1, 2, 5]), some(3))
            assert e.ids == library.encode_ordinary(e.text)
            assert e.prefixes == prefix_bpe.Encoding(codec, e.text).prefixes
        assert prefix_bpe.Encoding(codec, e.text, e.prefixes).ids == e.ids
        e.append("'re")
        assert e.ids == library.encode_ordinary(e.text)


def test_an_edit_of_a_long_word_makes_little_anew(codec, library):
    rng = random.Random(2)
    e = prefix_bpe.Encoding(codec, "".join(rng.choice("abcdetion") for _ in range(30_000)))
    e.edit(15_000, 3, "xyz")
    assert e.made < 500 and e.ids == library.encode_ordinary(e.text)
    e.append("ing")
    assert e.made == 3 and e.ids == library.encode_ordinary(e.text)


def test_a_token_no_merge_leads_to(tmp_path):
    import base64

    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"abc": 257, b"abx": 258}  # abx needs ab or bx, which are none
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(b) + b" %d\n" % i for b, i in ranks.items()))
    codec = prefix_bpe.PrefixCodec(str(path))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abx", "abxabx", "abcabx bcabc", "aabc"):
        assert codec.encode_batch([text])[0].tolist() == library.encode_ordinary(text) == prefix_bpe.Encoding(codec, text).ids


ROWS = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "<|endoftext|> x"), (None, "ÄÖ 日本語 😀"), (5, "word " * 20_000), (6, "x" * 30_000)]


def test_tables(spark, codec, library):
    docs = spark.createDataFrame([(*r, 9, "t", "m") for r in ROWS], "doc_id long, text string, n_tokens int, made string, `a.b` string")
    want = [(i, t or "", library.encode_ordinary(t or "")) for i, t in ROWS]
    got = prefix_bpe.round_trip(docs)
    assert got.columns == ["doc_id", "made", "a.b", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()))) == sorted(repr((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(t.encode()))) for i, t, x in want)
    encoded = prefix_bpe.encode(docs.select("doc_id", "text"))
    assert sorted(map(repr, ((r.doc_id, r.text or "", r.ids) for r in encoded.collect()))) == sorted(map(repr, want))
    assert {r.decoded for r in prefix_bpe.decode(encoded).collect()} == {t for _, t, _ in want}
    assert prefix_bpe.round_trip(docs.limit(0)).count() == 0 and prefix_bpe.encode(docs.limit(0)).count() == 0


def test_edits_of_a_table(spark, library):
    rows = [(1, "Hello wor", None, None, "ld"), (2, "one two three", 4, 3, "2"), (3, None, None, None, None), (4, "it", None, 0, "'s"), (5, "abc", 1, 99, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int, removed int, added string")
    got = {r.doc_id: (r.text, r.ids) for r in prefix_bpe.edit(prefix_bpe.encode(df)).collect()}
    want = {1: "Hello world", 2: "one 2 three", 3: "", 4: "it's", 5: "a"}
    assert got == {i: (t, library.encode_ordinary(t)) for i, t in want.items()}


def test_words_share_the_tables_of_their_common_starts():
    """Words with long common starts are not walked from their first bytes anew, and get the same ids as alone."""
    codec = prefix_bpe.PrefixCodec(public_tokenizers.path(prefix_bpe.VOCABULARY))
    words = [b" unquestionably" + bytes([97 + i, 97 + j]) * (1 + j) for i in range(26) for j in range(0, 26, 5)]
    walked, extend = [], codec.extend

    def counting(word, last, *more):
        walked.append(len(word) - len(last))
        extend(word, last, *more)

    codec.extend = counting
    got = codec.merge(words)
    shared = sum(walked)
    alone = [codec.merge([w])[0] for w in words]
    assert [list(x) for x in got] == [list(x) for x in alone]
    assert shared < 0.7 * sum(map(len, words))


def test_plain_words_are_those_of_the_library_pattern():
    import regex

    rng, usual = random.Random(3), regex.compile(public_tokenizers.PATTERN)
    words = prefix_bpe.Words()
    some = [chr(c) for c in range(128)] + list("  \n\t''''stvmldre") * 4
    for _ in range(3000):
        text = "".join(rng.choices(some, k=rng.randrange(40)))
        assert words.findall(text) == usual.findall(text)
        assert [m.span() for m in words.finditer(text, len(text) // 2)] == [m.span() for m in usual.finditer(text, len(text) // 2)]
