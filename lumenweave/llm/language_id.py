"""Operator 9: language identification.

Letters' scripts narrow each word's candidate languages; character n-gram models, counted over all
training rows, score every word in each candidate; the best labelling with a penalty for each switch
(Viterbi) gives spans, and the language with most letters is the text's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, crc_of_id, mix64, read_table, ship_package

BITS = 16  # of the n-gram table: fixed, so that the model doesn't grow with the corpus
SCRIPTS = (  # first code point of a range, its script; fixed values of Unicode's blocks
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "other-indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(s for _, s in SCRIPTS))
_FROM = np.array([a for a, _ in SCRIPTS])
_CODE = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS], dtype=np.int8)
_is_letter: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _is_letter:
        _is_letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _is_letter[0]


class Features:
    """Words (runs of letters) of a text and the hashed n-grams of each letter's place."""

    def __init__(self, text: str):
        low = text.lower()
        low = low if len(low) == len(text) else text
        c = np.frombuffer(low.encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = letter_table()[np.minimum(c, 0x10FFFF)]
        edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.at = np.flatnonzero(letter)
        padded = np.zeros(len(c) + 3, dtype=np.uint64)
        padded[2:-1] = np.where(letter, c, 0)
        one, two, nxt = padded[self.at + 2], padded[self.at + 1], padded[self.at + 3]
        three = np.where(two > 0, padded[self.at], 0)
        base = one | two << np.uint64(21)
        grams = [mix64(base | np.uint64(1) << np.uint64(63)), mix64(base | nxt << np.uint64(42))]
        grams.append(mix64(mix64(base) + (three << np.uint64(21) | nxt) + np.uint64(1)))
        self.grams = np.stack([(g >> np.uint64(64 - BITS)).astype(np.int32) for g in grams])
        self.first = np.searchsorted(self.at, self.starts)  # a word's first letter among the letters
        self.lengths = self.ends - self.starts
        self.script = _CODE[np.searchsorted(_FROM, c[self.starts], side="right") - 1] if len(self.starts) else np.empty(0, np.int8)


class Model:
    """Log probabilities of n-grams by language, and which scripts each language writes."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, switch: float = 20.0):
        self.langs, self.switch = langs, switch
        counts = counts if len(langs) else np.zeros((1, counts.shape[1]))  # no language: nothing is predicted
        p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        logs = np.log(p)
        self.logs = np.ascontiguousarray((logs - logs.mean(axis=0)).T.astype(np.float32))  # table entry x language
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.writes = (share >= 0.01).T  # script x language

    def word_scores(self, f: Features) -> np.ndarray:
        """words x languages; a language that doesn't write a word's script is out, unless none does."""
        total = self.logs[f.grams[0]]
        for g in f.grams[1:]:
            total = total + self.logs[g]
        scores = np.add.reduceat(total, f.first, axis=0) / len(f.grams)
        may = self.writes[f.script]
        return np.where(may | ~may.any(axis=1, keepdims=True), scores, -1e3)

    def label(self, scores: np.ndarray) -> np.ndarray:
        """The best language of each word when each switch costs ``switch``."""
        best = int(scores.sum(axis=0).argmax())
        run = np.zeros((len(scores) + 1, scores.shape[1]), dtype=np.float64)
        np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64, out=run[1:])
        # if no stretch gains half a switch elsewhere, no path beats the constant one
        if (run - np.minimum.accumulate(run, axis=0)).max() <= self.switch / 2:
            return np.full(len(scores), best)
        reach, cost = list(scores[0].tolist()), self.switch
        back = np.empty(scores.shape, dtype=np.int16)
        every = range(scores.shape[1])
        for t, s in enumerate(scores.tolist()):
            if not t:
                continue
            top = max(every, key=reach.__getitem__)
            over = reach[top] - cost
            for k in every:
                stay = reach[k] >= over
                back[t, k] = k if stay else top
                reach[k] = (reach[k] if stay else over) + s[k]
        path = np.empty(len(scores), dtype=np.int64)
        path[-1] = max(every, key=reach.__getitem__)
        for t in range(len(scores) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def spans(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """The text's language (``und`` without letters), a score from 0 to 1, and its spans in code points."""
        f = Features(text) if text else None
        if f is None or not len(f.at) or not self.langs:
            return "und", 0.0, []
        scores = self.word_scores(f)
        path = self.label(scores)
        letters = np.bincount(path, weights=f.lengths, minlength=len(self.langs))
        lang = int(letters.argmax())
        own = scores[path == lang].sum(axis=0)
        own = np.exp(np.clip(own - own.max(), -60, 0))
        score = float(letters[lang] / letters.sum() * own[lang] / own.sum())
        turn = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
        spans = [(int(f.starts[a]), int(f.ends[b - 1]), self.langs[path[a]]) for a, b in zip(turn, turn[1:])]
        return self.langs[lang], score, spans


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", switch: float = 20.0, most: int = 256) -> Model:
    """Count n-grams and scripts by language over every row with a language; what comes to the driver has a fixed size a language.

    More than ``most`` languages are an error: the model, which is broadcast, is 256 KB a language, and so many names mean
    that ``lang_col`` isn't one of languages. Null texts and languages teach nothing, an empty table gives a model that finds none.
    """
    spark = rows.sparkSession
    ship_package(spark)
    size = 1 << BITS
    rows = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    names = rows.select("lang").filter("lang IS NOT NULL").distinct().limit(most + 1).count()
    if names > most:
        raise ValueError(f"{lang_col} names more than {most} languages")

    def count(batches):
        import pyarrow as pa

        from .common import tidy

        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if lang is None or not text:
                    continue
                f = Features(text)
                if lang not in held:
                    held[lang] = np.zeros(size + len(SCRIPT_NAMES), dtype=np.int64)
                got = held[lang]
                if len(f.at):
                    got[:size] += np.bincount(f.grams.ravel(), minlength=size)
                    got[size:] += np.bincount(f.script, weights=f.lengths, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for lang, got in held.items():
            full = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(got[full])], names=["lang", "k", "n"]
            )
        del held
        tidy()

    found = (
        rows
        .mapInArrow(count, "lang string, k int, n long")
        .groupBy("lang", "k")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.collect_list(F.struct("k", "n")).alias("kn"))  # at most 2 ** BITS + scripts entries
        .select("lang", F.col("kn.k").alias("k"), F.col("kn.n").alias("n"))
        .toPandas()
        .sort_values("lang")
    )
    langs = found["lang"].tolist()
    table = np.zeros((len(langs), size + len(SCRIPT_NAMES)))
    for i, (k, n) in enumerate(zip(found["k"], found["n"])):
        table[i, np.asarray(k)] = np.asarray(n)
    return Model(langs, table[:, :size], table[:, size:], switch)


ADDED = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])),
        ),
    ]
)


def identify(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans`` (names after ``prefix``).

    A null or empty text, and one without a letter, is ``und`` with score 0 and no spans. Very long texts are labelled whole. Of languages with
    equally many letters the first by name is the text's. Repeated rows, null ids and other columns pass through; columns
    named like a result are replaced. An empty table gives an empty one.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts):
            got = [m.spans(t.decode("utf-8", "replace") if t else None) for t in texts]
            spans = [[{"start": a, "end": b, "lang": x} for a, b, x in s] for _, _, s in got]
            return [g[0] for g in got], [g[1] for g in got], spans

        return run

    added = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in ADDED.fields])
    return annotate(docs, text_col, make, added)


def held_out(id_col: str = "doc_id"):
    return F.pmod(crc_of_id(id_col), F.lit(4)) == 2


def train_on(docs: DataFrame) -> Model:
    """A model of the rows of ``documents`` that may teach: with a language, and not held out. A null id teaches."""
    return train(docs.filter(F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(False))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train_on(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
