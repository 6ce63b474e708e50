"""The pipeline on odd tables, and the bound on what its near-duplicate stage holds."""

from __future__ import annotations

import itertools
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import simhash

DATA = "/root/testdata/sf0.001"


def forest(group, keys, limit):
    """How many links a least spanning forest has in each group, and the sum of their distances."""
    out = []
    for x in np.unique(group):
        own = np.flatnonzero(group == x)
        top = {i: i for i in own}

        def root(i, top=top):
            while top[i] != i:
                i = top[i]
            return i

        for d, i, j in sorted((int(np.bitwise_count(keys[i] ^ keys[j]).sum()), i, j) for i, j in itertools.combinations(own, 2)):
            if d <= limit and root(i) != root(j):
                top[root(i)] = root(j)
                out.append(d)
    return len(out), sum(out)


@pytest.mark.parametrize("limit", [5, 20, 60, 300])
def test_trees_are_least_spanning_forests(limit):
    rng = np.random.default_rng(limit)
    group = np.sort(np.r_[rng.integers(0, 40, 300), np.full(150, 50), np.full(90, 51)])
    keys = rng.integers(0, 2**63, (12, 4)).astype(np.uint64)[rng.integers(0, 12, len(group))]
    for i in range(len(group)):
        for b in rng.integers(0, 256, rng.integers(0, 20)):
            keys[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    us, vs = simhash._tree(group, np.arange(len(group)), keys, limit)
    assert all(group[u] == group[v] for u, v in zip(us, vs, strict=True))
    assert (len(us), sum(int(np.bitwise_count(keys[u] ^ keys[v]).sum()) for u, v in zip(us, vs, strict=True))) == forest(group, keys, limit)


def test_many_large_groups_take_little_memory():
    code = """
import resource
import numpy as np
from plumbline.llm import simhash
group = np.repeat(np.arange(24), 2048)
keys = np.zeros((len(group), 4), np.uint64)
keys[:, 0] = np.random.default_rng(0).integers(0, 256, len(group))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
us, _ = simhash._tree(group, np.arange(len(group)), keys, 60)
assert len(us) == 24 * 2047
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ)
    assert int(said.stdout.split()[-1]) < 100


def made_pairs(n, seed=7):
    """(a, b): texts of 60 to 300 words and copies with a few words changed, of every similarity from 0.8 to 1."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        words = [f"w{x}" for x in rng.integers(0, 50_000, rng.integers(60, 300))]
        other = list(words)
        for k in rng.choice(len(words), rng.integers(1, max(2, len(words) // 40)), replace=False):
            other[k] = f"z{rng.integers(10**9)}"
        a, b = " ".join(words), " ".join(other)
        if simhash.jaccard(a, b, 5) >= 0.8:
            out.append((a, b))
    return out


def test_made_pairs_are_found(spark):
    """At least 97 of 100 made pairs of a similarity of 0.8 to 0.9 are found, and 995 of 1,000 above."""
    pairs = made_pairs(1500)
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = dict(map(tuple, simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    low, high = [], []
    for i, (a, b) in enumerate(pairs):
        assert got[2 * i] == 2 * i
        (low if simhash.jaccard(a, b, 5) < 0.9 else high).append(got[2 * i + 1] == 2 * i)
    assert min(len(low), len(high)) > 300 and np.mean(low) >= 0.97 and np.mean(high) >= 0.995


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(f"{''.join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))}" for _ in range(n)).capitalize() + "."


def write(spark, path, docs, labels, benchmark):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_odd_tables_go_through(spark, tmp_path):
    import corpus_pipeline

    passage = prose(50, 12)
    rows = [(1, prose(1)), (1, prose(1)), (2, prose(1) + " More."), (3, None), (4, ""), (5, " \n\t"), (None, prose(3)), (None, None), (7, prose(7, 30_000)), (8, prose(8) + " " + passage + " " + prose(9)), (9, prose(10))]
    docs = spark.createDataFrame([(*r, None, "s", None) for r in rows], SCHEMA)
    docs = docs.withColumns({c: F.lit(1) for c in ("key", "node", "sig", "score", "n_words", "kept", "ids", "_bpe", "top")})
    labels = spark.read.parquet(f"{DATA}/labels.parquet").withColumns({"doc_id": F.col("doc_id") + 10_000}).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, None), (9, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int"))
    benchmark = spark.createDataFrame([(1, passage), (2, None), (None, "")], "item_id long, text string")
    got = corpus_pipeline.run(spark, write(spark, tmp_path, docs, labels, benchmark))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = sorted((r.doc_id for r in got.collect()), key=repr)
    assert ids == sorted([1, None, 7, 8, 9], key=repr)  # one of each group; texts without words went


def test_empty_tables_go_through(spark, tmp_path):
    import corpus_pipeline

    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    none = write(spark, tmp_path / "a", read("documents").limit(0), read("labels"), read("benchmark"))
    assert corpus_pipeline.run(spark, none).count() == 0
    bare = write(spark, tmp_path / "b", read("documents").limit(50), read("labels").limit(0), read("benchmark").limit(0))
    assert 0 < corpus_pipeline.run(spark, bare).count() <= 50


def test_the_popcount_grid_finds_near_copies(spark, monkeypatch):
    """Without the longer signatures, the stage still drops copies whose fingerprints are equal or within three bits, and nothing unlike."""
    rng = np.random.default_rng(11)
    rows, near, equal = [], 0, 0
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 1500)]
        other = [*words[: 20 * i], "changed", *words[20 * i + 1 :]]
        a, b = " ".join(words), " ".join(other)
        apart = (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
        if apart <= simhash.MAX_DISTANCE:
            near, equal = near + (apart > 0), equal + (apart == 0)
            rows += [(2 * i, a), (2 * i + 1, b)]
    assert near > 20 and equal > 2
    rows += [(200, "one two three four five a"), (201, "one two three b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = lambda nodes, params: nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    monkeypatch.setattr(simhash, "similar_links", none)
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted({i for i, _ in rows if i % 2 == 0} | {201})


def shuffled(spark, run):
    """Bytes that the stages of ``run`` write to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_rows_that_stay_for_sure_are_not_shuffled(spark, tmp_path):
    """Texts without a like stay where they are, and the entries of a text are shuffled once."""
    rng = np.random.default_rng(5)
    long = [(i, " ".join(map(str, rng.integers(0, 10**9, 5000)))) for i in range(100)]
    long += [(1000 + i, t) for i, t in long[:5]] + [(2000 + i, "another " + t) for i, t in long[5:10]]
    short = [(i, " ".join(map(str, rng.integers(0, 10**9, 40)))) for i in range(2000)]
    for name, rows, limit in (("long", long, 0.5 * sum(len(t) for _, t in long)), ("short", short, 4700 * len(short))):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        kept = []
        moved = shuffled(spark, lambda docs=docs, kept=kept: kept.extend(simhash.drop_near_duplicates(docs).collect()))
        assert sorted(map(tuple, kept)) == [r for r in rows if r[0] < 1000 or name == "short"]
        assert 0 < moved < limit, (name, moved, limit)


def test_sifted_lets_no_key_go(spark):
    from plumbline.llm.common import SIFT_BITS, sifted

    edges = [-(2**63), -1, 0, 1, 32_767, 32_768, 32_769, SIFT_BITS - 1, 2**63 - 1]
    keys = spark.createDataFrame([(k,) for k in [*edges, *range(5, 70_000, 7)]], "key long")
    rows = spark.range(-10, 70_010).select(F.col("id").alias("key")).unionByName(keys)
    own = {r.key for r in keys.collect()}
    found = {r.key for r in sifted(rows, keys, "key").where("sifted").collect()}
    assert own <= found and found - own <= {k % SIFT_BITS - SIFT_BITS for k in own} | {k % SIFT_BITS for k in own}
    assert sifted(rows, keys.limit(0), "key").where("sifted").count() == 0
