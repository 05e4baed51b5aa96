"""Operator 8: quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Rules are sensitive: their bad votes
hit some good documents too. Vote patterns are counted over all documents, expectation-maximisation
estimates from these counts alone how often each rule votes which way on good and on bad documents and how
common good ones are, and a document is kept by its posterior probability, not by passing every rule: a bad
vote may be outweighed, and several abstentions may fail a document that no rule voted against.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, annotate, read_table, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines",
    "n_letters", "n_upper", "n_letter_words", "n_top_word", "n_distinct",
)


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The counts named in COUNTS, of one text."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        symbols = len(text) - len(text.translate(None, SYMBOLS)) if text else 0
        return (0, 0, symbols, *[0] * 9)
    s = text.decode("utf-8", "replace")
    joined = b"".join(words)
    word_chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    seen, dup, lines, ended = set(), 0, 0, 0
    for line in text.split(b"\n"):
        bare = line.strip(b" \t\r\x0b\x0c")
        if not bare:
            continue
        lines += 1
        ended += bare[-1] in b".!?:;\"'"
        if line in seen:
            dup += 1
        seen.add(line)
    repeated = 0
    if n >= 3:
        _, back, c = np.unique(window_hashes(word_hashes(text, False)[0], 3), return_inverse=True, return_counts=True)
        hit = np.zeros(n, dtype=bool)
        twice = c[back] > 1
        for i in range(3):
            hit[i : n - 2 + i] |= twice
        repeated = int(hit.sum())
    lower = s.lower()
    letters = sum(map(str.isalpha, s)) if not s.isascii() else len(text) - len(text.translate(None, _ASCII_LETTERS))
    n_upper = letters and (len(s) - sum(map(str.__eq__, s, lower)) if len(lower) == len(s) else sum(map(str.isupper, s)))
    letter_words = sum(1 for w in words if w[0] > 127 or w[:1].isalpha() or any(b > 127 or chr(b).isalpha() for b in w))
    each = Counter(text.lower().split())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (n, word_chars, symbols, dup, repeated, lines, ended, letters, n_upper, letter_words, max(each.values()), len(each))


_ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])


def count_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the COUNTS columns, which replace columns of these names; all 0 for a null or empty text."""

    def make():
        return lambda texts: list(zip(*map(text_counts, texts))) or [[] for _ in COUNTS]

    return annotate(docs, text_col, make, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))


def _vote(good, bad):
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict:
    """Rule -> its vote, on the COUNTS columns. Ratios have at least 1 below, so empty texts vote too."""
    c = F.col
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    low = lambda x, good, bad: _vote(x < good, x > bad)
    high = lambda x, good, bad: _vote(x > good, x < bad)
    word = per("word_chars", "n_words")
    return {
        "length": high(c("n_words"), 79, 50),
        "repeated_words": low(per("n_repeat_words", "n_words"), 0.05, 0.1),
        "duplicate_lines": low(per("n_dup_lines", "n_lines"), 0.02, 0.1),
        "symbols": low(per("n_symbols", "n_words"), 0.01, 0.1),
        "word_length": _vote(word.between(4.3, 6.2), ~word.between(4, 6.8)),
        "upper_case": low(per("n_upper", "n_letters"), 0.04, 0.06),
        "line_ends": high(per("n_ended_lines", "n_lines"), 0.9, 0.7),
        "letter_words": high(per("n_letter_words", "n_words"), 0.97, 0.95),
        "common_word": low(per("n_top_word", "n_words"), 0.08, 0.1),
        "distinct_words": high(per("n_distinct", "n_words"), 0.6, 0.5),
        "letters": high(per("n_letters", "word_chars"), 0.95, 0.9),
    }


class VoteModel:
    """Two classes; every rule votes independently given the class. ``fit`` takes pattern rows and their counts.

    Rates start from, and with ``weight`` pseudo-rows a class lean to, those of a rule that mostly says good of good documents;
    that only says which class is which, and is soon outweighed by the counts. A bad vote is never taken as
    evidence for quality: where the rates of a rule come out that way, the classes share their mean.
    """

    START = ((0.4, 0.2, 0.4), (0.03, 0.05, 0.92))  # of a bad, and of a good document: votes bad, abstains, votes good

    def __init__(self, n_rules: int, prior: float = 0.8, weight: float = 100.0):
        self.prior, self.weight = prior, weight
        self.p = np.repeat(np.array(self.START)[:, None, :], n_rules, axis=1)  # class x rule x (bad, abstains, good)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = votes.astype(int) + 1
        rule = np.arange(votes.shape[1])
        logs = [np.log(self.p[k][rule, at]).sum(axis=1) + np.log(self.prior if k else 1 - self.prior) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> VoteModel:
        start = self.p.copy()
        for _ in range(rounds if len(votes) else 0):
            q = self.posterior(votes)
            before, self.prior = self.prior, float(np.clip((q * counts).sum() / counts.sum(), 0.01, 0.99))
            for k, share in ((0, (1 - q) * counts), (1, q * counts)):
                said = np.stack([(share[:, None] * (votes == v)).sum(axis=0) for v in (-1, 0, 1)], axis=1) + self.weight * start[k]
                self.p[k] = said / said.sum(axis=1, keepdims=True)
            wrong = self.p[1][:, 0] > self.p[0][:, 0]
            self.p[:, wrong] = self.p[:, wrong].mean(axis=0)
            if abs(before - self.prior) < 1e-9:
                break
        return self


def quality_posterior(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, scratch: Scratch | None = None
) -> DataFrame:
    """Per row: the id, the base counts, ``base_failed``, ``quality`` (posterior) and ``kept``.

    A null text counts as empty: zero counts, base_failed. Null ids and repeated rows come back as they are, and equal texts get
    equal verdicts. Very long texts are counted whole. A posterior equal to ``threshold`` is kept. An empty table gives an empty
    result. Columns other than id and text are ignored, whatever their names. Counts go to the shared folder once, then
    patterns are counted over all of them: at most 3 ** 11 rows, and as many numbers a row.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "rules")
    votes = rule_votes()
    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    counted = count_columns(source, "__text").drop("__text")
    names = [f"v_{k}" for k in votes]
    # a pattern is one number, in base 3
    code = sum((v.cast("int") + 1) * 3**k for k, v in enumerate(votes.values()))
    rows = scratch.table(counted.withColumn("pattern", code.cast("int")), "counts")
    patterns = rows.groupBy("pattern").count().toPandas()
    seen = np.stack([patterns["pattern"].to_numpy() // 3**k % 3 - 1 for k in range(len(names))], axis=1).astype(np.int8)
    model = VoteModel(len(names)).fit(seen, patterns["count"].to_numpy(dtype=float))
    table = spark.createDataFrame(list(zip(patterns["pattern"].tolist(), model.posterior(seen).tolist())), "pattern int, quality double")
    scored = rows.join(F.broadcast(table), "pattern")  # 3 ** 11 rows of two numbers at most
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality",
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_posterior(read_table(spark, sf_dir, "documents"))
