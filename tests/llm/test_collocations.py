"""Operator 12 against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import connect, differences
from test_llm import SF

from lumenweave.llm import collocations as col
from lumenweave.llm.collocations import Words, collocations
from lumenweave.llm.queries import llm_oracle_sql, llm_queries


def plain(docs, longest=5, least=100, contained=100, top=2000):
    """grp -> list of (phrase, a, l, r, n, score) in rank order, by counting every phrase."""
    count, total = {}, Counter()
    for group, text in docs:
        group = "und" if group is None else group
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[group] += len(words)
            for k in range(1, longest + 1):
                count.setdefault(group, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for group, f in count.items():
        n, rows = total[group], []
        frequent = {p for p, a in f.items() if a >= least and len(p) > 1}
        longer = Counter()
        for p in frequent:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], f[p])
        for p in frequent:
            if longer[p] and 100 * longer[p] >= contained * f[p]:
                continue
            score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((" ".join(p), f[p], f[p[:k]], f[p[k:]], n, score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        if rows:
            out[group] = rows[:top]
    return out


def answer(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.grp, r.rank)):
        out.setdefault(r.grp, []).append((r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert r.rank == len(out[r.grp])
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    docs = []
    for k in range(400):
        words = rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(60))
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words) + 1), "Alpha beta  GAMMA\tdelta")
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "!"]) for w in words)
        docs.append((rng.choice(["en", "fr", None, "und"]), text))
    return [*docs, *docs[:40], ("en", None), ("fr", ""), (None, " ,. "), ("de", "x"), ("en", "a b " * 300), ("en", "z" * 5000)]


@pytest.mark.parametrize("settings", [{}, {"least": 5}, {"least": 7, "longest": 3, "top": 9}, {"least": 300, "contained": 60}, {"least": 4, "contained": 50, "longest": 6}])
def test_by_counting(spark, made, settings):
    docs = spark.createDataFrame([(g, t, k, "x") for k, (g, t) in enumerate(made)], "lang string, text string, rank long, a string").repartition(3)
    assert answer(collocations(docs, **settings)) == plain(made, **settings)


def test_small_chunks_and_few_buckets_change_nothing(spark, made, monkeypatch):
    monkeypatch.setattr(col, "CHUNK", 700)
    monkeypatch.setattr(col, "BUCKETS", 64)
    monkeypatch.setattr(col, "BLOCK", 16)
    docs = spark.createDataFrame(made, "lang string, text string").repartition(2)
    assert answer(collocations(docs, least=5)) == plain(made, least=5)


def test_edges(spark, made):
    docs = spark.createDataFrame(made, "lang string, text string")
    assert collocations(docs.limit(0)).collect() == []
    assert collocations(docs.select("text"), group_col=None, least=20).select("grp").distinct().collect()[0].grp == "und"
    with pytest.raises(ValueError):
        collocations(docs, longest=1)


def test_counts_beyond_64_bits(spark):
    """1000 * a * n passes 2 ** 63 at large counts; the score expression is exact there."""
    a, n, l, r = 3_000_000_000_001, 9_000_000_000_000_007, 3_000_000_000_005, 7_000_000_000_003
    row = spark.sql(f"SELECT {a}L AS a, {n}L AS n, {l}L AS l, {r}L AS r").selectExpr("cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s")
    assert row.first().s == 1000 * a * n // (l * r)


def test_bitmaps_have_no_misses():
    h = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64)
    bits = np.zeros(1 << 13, dtype=np.uint8)
    at = h & np.uint64(8 * len(bits) - 1)
    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(int), (1 << (at & np.uint64(7))).astype(np.uint8))
    assert col._has(bits, h).all() and not col._has(np.zeros(1 << 13, dtype=np.uint8), h).any()


def test_words_of_a_chunk():
    w = Words([b"One,two\tTHREE", b"", b"one \xc3\xa9"], [0, 0, 1], ["a", "b"])
    assert [w.names[i].as_py() for i in w.code] == [b"one", b"two", b"three", b"one", "é".encode()]
    assert w.starts(2).tolist() == [1, 3] and w.group.tolist() == [0, 0, 0, 1, 1]
    assert len(set(w.hashes(1, np.array([0, 3])).tolist())) == 2


def test_query_matches_sql(spark):
    got = llm_queries()["op12_collocations"](spark, SF)
    assert differences(got, llm_oracle_sql()["op12_collocations"], connect(SF)) == []
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert answer(got.withColumnRenamed("lang", "grp")) == plain(docs)
