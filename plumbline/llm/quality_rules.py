"""Quality rules: learned decision lists over native text statistics.

The statistics and the verdict are Spark expressions only.  Learning reads the
statistics of a bounded sample of labelled rows (``Params.max_labelled``), grows
and prunes threshold conjunctions by sequential covering on the driver, and
gives back an ordered list that becomes one CASE expression.

Defined results: null text counts as empty and has no words; a text without
words fails the base rules; unlabelled corpora, or ones where every label is
alike, learn an empty list and keep all that passes the base rules; texts of any
length are read whole; repeated rows are judged one by one; of several labelled
texts under one doc_id the one with the least statistics is learned from; ties
between conditions go to the first in the order of features and thresholds; an
empty table gives an empty result; columns named like a statistic or verdict are
replaced, all others kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, sampled_ids, shielded, text_or_empty

WINDOW = 5
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Params:
    max_labelled: int = 20_000
    max_rules: int = 12
    max_conditions: int = 4
    thresholds: int = 64
    min_cover: int = 5
    min_precision: float = 0.95


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold) that rejects a text."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, value in self.conditions:
            out &= F.col(name) <= value if op == "<=" else F.col(name) > value
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {v:.6g}" for n, op, v in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def rule_index(self) -> Column:
        """The number of the first rule that fits, from 1; null where none does."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.column(), F.lit(k)).otherwise(out)
        return out


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of five that occur twice or more.

    A hash per window tells whether any repeats at all: equal windows have equal
    hashes, so as many distinct hashes as windows means none.  Only the other
    texts sort their windows, as strings, so that the count is exact.
    """
    n = F.size("_w")
    span = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(span, lambda i: F.xxhash64(*(F.get(F.col("_w"), i + k) for k in range(WINDOW))))
    df = df.withColumn("_h", F.when(n >= WINDOW, hashes))
    df = df.withColumn("_again", F.coalesce(F.size(F.array_distinct("_h")) < F.size("_h"), F.lit(False)))
    windows = F.transform(span, lambda i: F.struct(F.concat_ws(" ", *(F.get(F.col("_w"), i + k) for k in range(WINDOW))).alias("s"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.col("_again"), F.sort_array(windows))).drop("_h")
    s = F.col("_s")
    like = lambda e, j: F.coalesce(F.get(s, j)["s"] == e["s"], F.lit(False))
    df = df.withColumn("_p", F.when(F.col("_again"), F.sort_array(F.transform(F.filter(s, lambda e, j: like(e, j - 1) | like(e, j + 1)), lambda e: e["i"])))).drop("_s")
    p, k = F.col("_p"), F.size("_p")
    gaps = F.zip_with(F.slice(p, F.lit(1), k - 1), F.slice(p, F.lit(2), k - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
    covered = F.when(F.col("_again") & (k > 0), F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g) + WINDOW)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p", "_again")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its clashing columns, with the base counts and the rule features."""
    made = [*BASE, "base_failed", "kept", "rule", *FEATURES]
    docs = docs.drop(*[c for c in docs.columns if c in made])
    df, back = shielded(docs, (text,))
    own = df.columns
    df = df.withColumn("_t", text_or_empty(text))
    without = lambda chars: F.length(F.translate("_t", chars, ""))
    df = df.withColumn("_w", F.array_remove(F.split("_t", r"[ \x09-\x0D]+"), ""))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")))
    chars = F.length("_t")
    df = df.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        without(WHITE).cast("long").alias("word_chars"),
        (chars - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").alias("_lines"),
        F.size(F.array_distinct("_w")).alias("_vocab"),
        (chars - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("_upper"),
        (chars - without("0123456789")).alias("_digits"),
        (chars - without("!?")).alias("_bang"),
        (chars - without(".,;:'\"()-")).alias("_punct"),
    )
    df = _repeat_words(df).drop("_w", "_l", "_t")
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    letters = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    made = F.struct(
        *BASE,
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.col("n_words").cast("double").alias("f_words"),
        (F.col("word_chars") / words).alias("f_word_length"),
        (F.col("n_symbols") / words).alias("f_symbols"),
        (F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1))).alias("f_dup_lines"),
        (F.col("n_repeat_words") / words).alias("f_repeats"),
        (F.col("_vocab") / F.sqrt(words)).alias("f_vocabulary"),
        (F.col("_upper") / letters).alias("f_upper"),
        (F.col("_digits") / letters).alias("f_digits"),
        (F.col("_bang") / words).alias("f_exclaim"),
        (F.col("_punct") / words).alias("f_punctuation"),
        (F.col("_lines") / words).alias("f_lines"),
    )
    # A generator keeps filters on these columns from being pushed below, where
    # each would compute the word arrays anew for every use.
    return back(df.select(*own, F.inline(F.array(made))), [*BASE, "base_failed", *FEATURES])


FEATURES = ["f_words", "f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_vocabulary", "f_upper", "f_digits", "f_exclaim", "f_punctuation", "f_lines"]


def _conditions(x: np.ndarray, count: int) -> list[tuple[int, str, float]]:
    out = []
    for j in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, count + 2)[1:-1], method="lower")):
            out += [(j, "<=", float(t)), (j, ">", float(t))]
    return out


def _fits(x: np.ndarray, c: tuple[int, str, float]) -> np.ndarray:
    return x[:, c[0]] <= c[2] if c[1] == "<=" else x[:, c[0]] > c[2]


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], params: Params = Params()) -> DecisionList:
    """Sequential covering: grow on two thirds, prune on one third, drop what is covered.

    ``bad`` marks the rows to reject.  A rule is kept if, on all rows not yet
    covered, it rejects ``min_cover`` bad rows or more with ``min_precision``.
    """
    if not len(x) or bad.all() or not bad.any():
        return DecisionList()
    x, bad = np.asarray(x, float), np.asarray(bad, bool)
    part = np.arange(len(x)) % 3 == 2
    pool = _conditions(x, params.thresholds)
    masks = np.array([_fits(x, c) for c in pool])
    left, rules = np.ones(len(x), bool), []
    while len(rules) < params.max_rules:
        grow, prune = left & ~part, left & part
        now, taken = grow.copy(), []
        while len(taken) < params.max_conditions and (now & ~bad).any():
            p0, n0 = (now & bad).sum(), (now & ~bad).sum()
            if not p0:
                break
            p, n = (masks & (now & bad)).sum(1), (masks & (now & ~bad)).sum(1)
            gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
            best = int(np.argmax(np.where(p >= params.min_cover, gain, -np.inf)))
            if p[best] < params.min_cover or gain[best] <= 1e-9:
                break
            taken.append(best)
            now &= masks[best]
        if not taken:
            break
        worth = []
        for k in range(1, len(taken) + 1):
            hit = prune & masks[taken[:k]].all(0)
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            worth.append((p - n) / (p + n) if p + n else -1.0)
        taken = taken[: int(np.argmax(worth)) + 1]
        hit = left & masks[taken].all(0)
        good = (hit & bad).sum()
        if good < params.min_cover or good < params.min_precision * hit.sum():
            break
        rules.append(Rule(tuple((names[pool[c][0]], pool[c][1], pool[c][2]) for c in taken), int(hit.sum()), float(good / hit.sum())))
        left &= ~hit
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DecisionList:
    """Learns from the statistics of ``params.max_labelled`` labelled documents at most.

    labels: doc_id, quality (0 is bad).  A document with several labels counts as
    bad if any of them says so.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    known = sampled_ids(known, params.max_labelled)  # so many rows at most may be broadcast
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(known.withColumnRenamed("_quality", "quality")), "doc_id")).where(~F.col("base_failed"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *FEATURES)).alias("row"))
    got = sorted(tuple(r) for r in one.select("doc_id", "row.*").collect())
    if not got:
        return DecisionList()
    data = np.array([r[2:] for r in got], float)
    return learn(data, np.array([r[1] == 0 for r in got]), FEATURES, params)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its statistics, base_failed, the rule that fits and kept."""
    df = statistics(docs, text).withColumn("rule", rules.rule_index())
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_documents(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    rules = fit(docs, labels, params)
    own, restore = shielded(docs)
    return restore(judge(own, rules).where("kept"))
