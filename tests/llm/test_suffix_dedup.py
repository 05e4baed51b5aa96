"""Operator 13 against all windows in a dictionary."""

import hashlib
import random

import numpy as np
import pytest
from oracle import connect, differences
from test_llm import SF

from lumenweave.llm import suffix_dedup as sd
from lumenweave.llm.queries import llm_oracle_sql, llm_queries
from lumenweave.llm.suffix_dedup import blind_trie, common_prefix, deep_shallow, merged, remove_repeats, text_anchors, unpack


def brute(docs, span=100):
    """(id, bytes) -> (removed spans, kept bytes), for distinct documents whose ids differ."""
    seen, out = set(), {}
    for doc, text in sorted(set(docs), key=lambda x: (x[0] is not None, x[0])):
        covered = bytearray(len(text))
        for s in range(len(text) - span + 1):
            if (w := text[s : s + span]) in seen:
                covered[s : s + span] = b"\1" * span
            seen.add(w)
        edges = [k for k in range(len(text) + 1) if (covered[k] if k < len(text) else 0) != (covered[k - 1] if k else 0)]
        spans = list(zip(edges[::2], edges[1::2]))
        out[doc, text] = spans, bytes(b for b, c in zip(text, covered) if not c)
    return out


def answer(df):
    out = {}
    for r in df.collect():
        got = [(x.start, x.end) for x in r.removed], bytes(r.kept)
        assert out.setdefault((r.doc_id, (r.text or "").encode()), got) == got
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéß日 ") for _ in range(rng.randrange(1, 9)))
    passage = " ".join(word() for _ in range(40))
    base = [" ".join(word() for _ in range(rng.randrange(90))) for _ in range(40)]
    docs = []
    for k in range(160):
        t = rng.choice(base) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(60)))
        if rng.random() < 0.5:
            i = rng.randrange(len(t) + 1)
            t = t[:i] + passage[rng.randrange(20) : rng.randrange(60, len(passage))] + t[i:]
        if rng.random() < 0.3 and t:
            i = rng.randrange(len(t))
            t = t[:i] + word() + t[i + 3 :]
        docs.append((k * 3 - 40, t))
    more = ["", "a" * 700, "ab" * 300, "a" * 99, "a" * 100, "a" * 101, "x" + "a" * 150, "abc" * 90 + "\0" * 120, "\0" * 300, passage * 3, passage[:150] + "\0", passage[:150] + "\0\0"]
    return docs + [(1000 + k, t) for k, t in enumerate(more)] + [(None, base[0]), (5000, base[0])]


@pytest.mark.parametrize("span", [1, 7, 40, 100, 131])
def test_by_all_windows(spark, made, span):
    docs = spark.createDataFrame([*made, *made[::9], (9000, None)], "doc_id long, text string").repartition(3)
    assert answer(remove_repeats(docs, span=span)) == brute([(d, t.encode()) for d, t in made] + [(9000, b"")], span)


@pytest.mark.parametrize("names", [{"HOT": 2}, {"CHUNK": 1500}, {"PIECE": 256, "SHALLOW": 8}, {"BUCKET_ROWS": 20, "SHALLOW": 104}])
def test_other_settings_change_nothing(spark, made, monkeypatch, names):
    for name, value in names.items():
        monkeypatch.setattr(sd, name, value)
    if "SHALLOW" in names:
        monkeypatch.setattr(sd.deep_shallow, "__defaults__", (names["SHALLOW"],))
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
    assert answer(remove_repeats(docs)) == brute([(d, t.encode()) for d, t in made])


def test_edges(spark, made):
    docs = spark.createDataFrame([(1, "p" * 300, "x", 2), (1, "q" * 20 + "p" * 300, "y", 3), (1, "p" * 300, "z", 4)], "doc_id int, text string, kept string, spans int")
    out = remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "spans", "removed", "kept"] and {r.spans for r in out.collect()} == {2, 3, 4}
    sizes = sorted(sum(x.end - x.start for x in r.removed) for r in out.collect())
    # rows equal in id and text are one document; either it or the other row of that id comes first
    assert sizes in ([299, 299, 300], [299, 300, 300])
    assert remove_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(docs, span=0)
    with pytest.raises(TypeError):
        remove_repeats(docs.selectExpr("string(doc_id) AS doc_id", "text"))


def test_sort_against_sorted():
    rng = random.Random(2)
    for trial in range(60):
        strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.choice([0, 1, 5, 9, 16, 17, 40, 60]))) for _ in range(rng.randrange(1, 60))]
        strings += [s + b"\0" * rng.randrange(3) for s in strings]
        for shallow in (8, 16, 40):
            order, lcp = deep_shallow(strings, shallow)
            got = [strings[i] for i in order]
            assert got == sorted(strings) and sorted(order) == list(range(len(strings)))
            assert lcp.tolist() == [0] + [common_prefix(a, b) for a, b in zip(got, got[1:])]
        ids = list(range(len(strings)))
        out, lcps = blind_trie(strings, ids)
        assert [strings[i] for i in out] == sorted(strings) and lcps == [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(out, out[1:])]
    assert common_prefix(b"", b"x") == 0 and common_prefix(b"ab", b"abc") == 2 and common_prefix(b"\0a", b"\0b") == 1


def test_every_window_has_one_anchor(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 256)
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (0, 99, 100, 101, 250, 2000)]
    doc, at, h = text_anchors(texts, 100)
    place, most, least = unpack(at)
    windows = {}
    for d, p, m, l, g in zip(doc.tolist(), place.tolist(), most.tolist(), least.tolist(), h.tolist()):
        for o in range(l, m + 1):
            assert (d, p - o) not in windows
            windows[d, p - o] = o
    assert set(windows) == {(d, s) for d, t in enumerate(texts) for s in range(len(t) - 99)}
    distance = {}
    for (d, s), o in windows.items():
        assert distance.setdefault(texts[d][s : s + 100], o) == o


def test_merged_spans():
    assert merged([5, 9, 1, 3, 3, 4, 8, 20, 30, 31]) == [(1, 4), (5, 20), (30, 31)] and merged([]) == [] and merged([1, 100, 2, 3]) == [(1, 100)]
    assert np.array_equal(sd._equal_bytes(np.array([1, 1 << 63, 1 << 16], dtype=np.uint64)), [7, 0, 5])


def test_query_by_all_windows(spark):
    rows = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (len(t), spans, kept) for (d, t), (spans, kept) in brute(rows).items()}
    df = llm_queries()["op13_suffix_dedup"](spark, SF)
    for r in df.collect():
        n, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert differences(df, llm_oracle_sql()["op13_suffix_dedup"], connect(SF)) == []
