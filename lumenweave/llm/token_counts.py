"""Operator 1: token counts by a linear longest-match automaton.

A vocabulary trie carries a failure link and the number of pieces popped on following it, so one
left-to-right pass gives how many greedy longest-match pieces a word has, without building any piece.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, read_table, ship_package

END = 256  # the symbol after a word's last byte; pieces that close a word end in it
NONE = -1


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes: stand-in -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_pieces(path: str, closing: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file as symbol tuples; the closing mark becomes END."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces = []
    for piece in vocab:
        body, ends = (piece[: -len(closing)], True) if piece.endswith(closing) else (piece, False)
        if all(c in letters for c in body):
            pieces.append(tuple(letters[c] for c in body) + ((END,) if ends else ()))
    return pieces


class MatchAutomaton:
    """Greedy longest-match piece counts in time linear in the word.

    Where the last piece has no closing form the closing mark stands alone, and counts nothing.
    """

    def __init__(self, pieces, cache_limit: int = 400_000):
        goto: list[dict[int, int]] = [{}]
        whole = [False]
        parents: list[tuple[int, int]] = [(NONE, NONE)]
        for piece in pieces:
            at = 0
            for s in piece:
                nxt = goto[at].get(s)
                if nxt is None:
                    nxt = goto[at][s] = len(goto)
                    goto.append({})
                    whole.append(False)
                    parents.append((at, s))
                at = nxt
            if at:
                whole[at] = True
        alone = goto[0].get(END)
        if alone is None:
            alone = goto[0][END] = len(goto)
            goto.append({})
            whole.append(True)
            parents.append((0, END))
        fail, popped = [NONE] * len(goto), [0] * len(goto)
        level = list(goto[0].values())
        while level:
            for v in level:
                parent, s = parents[v]
                if whole[v]:
                    fail[v], popped[v] = 0, int(v != alone)
                    continue
                z, pops = fail[parent], popped[parent]
                while z != NONE and s not in goto[z]:
                    pops += popped[z]
                    z = fail[z]
                if z != NONE:
                    fail[v], popped[v] = goto[z][s], pops
            level = [w for v in level for w in goto[v].values()]
        self.goto, self.fail, self.popped = goto, fail, popped
        self.cache, self.cache_limit = {}, cache_limit

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 0 where the vocabulary can't spell it."""
        goto, fail, popped = self.goto, self.fail, self.popped
        at = n = 0
        for s in (*word, END):
            nxt = goto[at].get(s)
            while nxt is None:
                n += popped[at]
                at = fail[at]
                if at == NONE:
                    return 0
                nxt = goto[at].get(s)
            at = nxt
        while at:
            n += popped[at]
            at = fail[at]
            if at == NONE:
                return 0
        return n

    def counts(self, words: list[bytes]) -> list[int]:
        cache, out = self.cache, []
        for w in words:
            n = cache.get(w)
            if n is None:
                if len(cache) >= self.cache_limit:
                    cache.clear()
                n = cache[w] = self.count(w)
            out.append(n)
        return out


ADDED = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_unknown", T.LongType())]
)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_words``, ``n_tokens`` (an unspellable word counts as one) and ``n_unknown``.

    Words are runs of bytes that are not ASCII white space, with A-Z lowered. A null or empty text, or
    one of white space only, has zeros; a very long one is counted whole, and so is a very long word, in time that is linear in it. Of pieces that
    match at one place the longest is taken, so there are no ties. Null ids and repeated rows come back as they are, one row
    each; ids may be of any type; an empty table gives an empty result. Other columns are dropped, whatever their names.
    The vocabulary (fixed size) is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    ship_package(spark)
    pieces = spark.sparkContext.broadcast(load_pieces(vocabulary))

    def make():
        automaton = MatchAutomaton(pieces.value)

        def run(texts):
            n_words, n_tokens, n_unknown = [], [], []
            for t in texts:
                got = automaton.counts(t.lower().split()) if t else []
                unknown = got.count(0)
                n_words.append(len(got))
                n_tokens.append(sum(got) + unknown)
                n_unknown.append(unknown)
            return n_words, n_tokens, n_unknown

        return run

    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    return annotate(source, "__text", make, ADDED).drop("__text").withColumnRenamed("__id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
