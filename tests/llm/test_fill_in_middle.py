"""Operator 11 against plain string slices."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_llm import SF

from lumenweave.llm.fill_in_middle import cut_middle, fill_in_middle, restored, select, unit_starts
from lumenweave.llm.queries import llm_queries

CASES = ["", "a", "é", "ab <P> c", "<M>", "née à Gödel 日本語 𝒳𝒴", "<S", "x\0y", "  two  words ", "line\n\nline\n", "<" * 50, "a" * 70_000 + "日" * 70_000]


def plain(doc_id, text, seed=1, rate=90, spm_rate=20):
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    draws = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    text = text or ""
    n = len(text)
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    if draws[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_selected_bits():
    rng = random.Random(3)
    for width in (1, 2, 7, 64, 65, 1000):
        mask = rng.getrandbits(width) | 1
        places = [k for k in range(width) if mask >> k & 1]
        assert [select(mask, k) for k in range(len(places))] == places


@pytest.mark.parametrize("text", CASES)
def test_units_begin_where_they_should(text):
    raw = text.encode()
    ones = lambda mask: [k for k in range(len(raw)) if mask >> k & 1] if len(raw) < 1000 else None
    if len(raw) < 1000:
        assert ones(unit_starts(raw)) == [len(text[:k].encode()) for k in range(len(text))]
        words = {0} | {m.start() for m in re.finditer(rb"(?<=[\t-\r ])[^\t-\r ]", raw)} if raw else set()
        assert ones(unit_starts(raw, "words")) == sorted(words)
        lines = {0} | {k + 1 for k, b in enumerate(raw) if b == 10 and k + 1 < len(raw)} if raw else set()
        assert ones(unit_starts(raw, "lines")) == sorted(lines)
    n, a, b, i, j = cut_middle(raw, 123_456, 999)
    assert n == len(text) and (text[:a].encode(), text[a:b].encode()) == (raw[:i], raw[i:j])


def test_forms_and_edges(spark):
    rows = [(k, t, "x") for k, t in enumerate(CASES * 4)] + [(7, CASES[6], "y"), (900, None, "z"), (None, "abc", "w"), (-5, "neg é", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    out = fill_in_middle(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "n", "form", "prefix_units", "middle_units", "output"])
    got = {(r.doc_id, r.text): (r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in out.collect()}
    want = {(k, t): plain("" if k is None else k, t) for k, t, _ in rows}
    assert got == want and {w[1] for w in want.values()} == {"plain", "psm", "spm"}
    again = out.select("text", restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all((r.text or "") == r.back for r in again)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_settings(spark):
    docs = spark.createDataFrame([(k, "one two\nthree four") for k in range(200)], "doc_id long, text string")
    rows = fill_in_middle(docs, units="words", rate=100, spm_rate=100, seed=9, prefix="f_").collect()
    assert {r.f_form for r in rows} == {"spm"} and {r.f_n for r in rows} == {4}
    assert {re.split("<S>|<P>|<M>", r.f_output)[2] for r in rows} <= {"", "one ", "one two\n", "one two\nthree ", "one two\nthree four"}
    with pytest.raises(ValueError):
        fill_in_middle(docs, marks=("<A>", "<A>", "<B>"))
    with pytest.raises(ValueError):
        fill_in_middle(docs, units="syllables")
    with pytest.raises(TypeError):
        fill_in_middle(docs.withColumn("doc_id", F.lit("a")))


def test_query_by_slices(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = llm_queries()["op11_fill_in_middle"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, a, m, output = plain(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, a, m, digest(output))
        assert r.restored_sha256 == digest(texts[r.doc_id])
