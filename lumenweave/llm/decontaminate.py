"""Operator 2: benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined by their seeds (runs of ``least`` words). A pair that shares enough of
them is tiled: running Karp-Rabin hashes find the longest common runs of words that are still unmarked, these
are marked longest first without overlap, and the search length falls until it reaches ``least``. The share of
the item's words under tiles, in whatever order they stand in the document, decides.

Documents are read once, whatever the benchmark's size. Of each only the seeds and words go on that may
match: where the benchmark has few seeds, all of them are broadcast and tell which; beyond that bound all seeds
of all documents take part in the join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, long_id, mix64, read_table, tidy, window_hashes, word_hashes

EDGE = bytes(b for b in range(33, 127) if not chr(b).isalnum())  # trimmed from a word's ends
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_SEEDS = 4_000_000  # of the benchmark, which are broadcast (32 MB) where there are no more


def word_keys(text: bytes | None) -> np.ndarray:
    """Hashes (none is 0) of a text's words without case (A-Z) and without ASCII punctuation at their ends; words of nothing else are left out."""
    h, bare = word_hashes(text, True, EDGE)
    return np.maximum(h[bare], np.uint64(1))


def _runs(h: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``s`` words that are wholly free, and where they begin."""
    if len(h) < s:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        # Karp-Rabin by prefix sums: window = (prefix[i+s] - prefix[i]) / BASE ** i, modulo 2 ** 64
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(h), BASE, dtype=np.uint64))])
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h) * power[:-1], dtype=np.uint64)])
        start = np.arange(len(h) - s + 1)
        taken = np.concatenate([[0], np.cumsum(~free)])
        start = start[taken[start + s] == taken[start]]
        # compare at a common power: multiply by BASE ** (len - i) instead of dividing
        return (prefix[start + s] - prefix[start]) * power[len(h) - start], start


def tile(item: np.ndarray, doc: np.ndarray, least: int, first: int = 20) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, document place, length) of two word-hash sequences, longest first."""
    tiles: list[tuple[int, int, int]] = []
    free_i, free_d = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    # one power for both sequences: pad to one length in front
    n = max(len(item), len(doc))
    s = max(least, min(first, len(item)))
    while True:
        pad = lambda h: np.concatenate([h, np.zeros(n - len(h), dtype=np.uint64)])
        blocked = lambda f: np.concatenate([f, np.zeros(n - len(f), dtype=bool)])
        hi, at_i = _runs(pad(item), blocked(free_i), s)
        hd, at_d = _runs(pad(doc), blocked(free_d), s)
        order = np.argsort(hi, kind="stable")
        left, right = np.searchsorted(hi[order], hd, "left"), np.searchsorted(hi[order], hd, "right")
        found, longest = [], 0
        for d, a, b in zip(at_d[left < right].tolist(), left[left < right].tolist(), right[left < right].tolist()):
            for i in at_i[order[a:b]].tolist():
                if i and d and item[i - 1] == doc[d - 1] and free_i[i - 1] and free_d[d - 1]:
                    continue  # part of the run that begins before
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and free_i[i + k] and free_d[d + k]:
                    k += 1
                if k >= s:
                    found.append((-k, i, d))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        found.sort()
        for k, i, d in found:
            k = -k
            if free_i[i : i + k].all() and free_d[d : d + k].all():
                free_i[i : i + k] = False
                free_d[d : d + k] = False
                tiles.append((i, d, k))
        if s == least:
            # what an overlap shortened may still hold a tile
            if not any(free_i[i : i - k].any() for k, i, d in found) or not found or not _again(found, free_i, free_d, least):
                return tiles
            continue
        s = max(least, s // 2)


def _again(found, free_i, free_d, least: int) -> bool:
    """Whether some candidate keeps a free common run of ``least`` words."""
    for k, i, d in found:
        both = free_i[i : i - k] & free_d[d : d - k]
        run = 0
        for x in both.tolist():
            run = run + 1 if x else 0
            if run >= least:
                return True
    return False


ITEMS = "item long, item_id long, n long, width int, words binary, seeds array<long>, times array<int>"


def benchmark_items(benchmark: DataFrame, least: int, item_col: str, text_col: str) -> DataFrame:
    """Per benchmark row with words: a number of its own, its words as hashes, and its distinct seeds with how often each occurs."""

    def run(batches):
        from pyspark import TaskContext

        item = TaskContext.get().partitionId() << 32
        for b in batches:
            rows = []
            for item_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                h = word_keys(text.as_py())
                if len(h):
                    w = min(least, len(h))
                    seeds, times = np.unique(window_hashes(h, w), return_counts=True)
                    rows.append((item, item_id, len(h), w, h.tobytes(), seeds.view(np.int64), times.astype(np.int32)))
                    item += 1
            cols = list(zip(*rows)) or [[] for _ in range(7)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in ITEMS.split(", ")])

    return benchmark.select(long_id(benchmark, item_col).alias("item_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, ITEMS)


HITS = "doc_id long, digest string, seeds array<long>, part binary"


def seed_hits(docs: DataFrame, widths: list[int], known: np.ndarray | None) -> DataFrame:
    """Per document (doc_id, text) with a seed in ``known`` (or with any, where that is None): its text's digest, these seeds, and the
    words under them as hashes, with 0 between stretches: only there can tiles lie."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known = shared.value
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                text = text.as_py()
                h = word_keys(text)
                seeds, covered = [], np.zeros(len(h), dtype=bool)
                for w in widths:
                    if len(h) < w:
                        continue
                    x = window_hashes(h, w)
                    at = np.arange(len(x)) if known is None else np.flatnonzero(known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x)
                    if len(at):
                        seeds.append(x[at])
                        for i in range(w):
                            covered[at + i] = True
                if seeds:
                    keep = np.flatnonzero(covered)
                    gaps = np.flatnonzero(np.diff(keep) > 1) + 1
                    part = np.insert(h[keep], gaps, np.uint64(0))
                    rows.append((doc, hashlib.md5(text).hexdigest(), np.unique(np.concatenate(seeds)).view(np.int64), part.tobytes()))
            cols = list(zip(*rows)) or [[] for _ in range(4)]
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "digest", "seeds", "part"])
        tidy()

    return docs.mapInArrow(run, HITS)


def tiled(pairs: DataFrame, share: float) -> DataFrame:
    """Rows (digest, part, item, item_id, n, width, words) -> those whose tiles cover ``share`` of the item or more, with what the tiles are."""

    def run(batches):
        for b in batches:
            rows = []
            columns = [b.column(c) for c in ("digest", "part", "item_id", "width", "words")]
            for digest, part, item_id, width, words in zip(*columns):
                item, doc = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (words, part))
                tiles = tile(item, doc, width.as_py())
                coverage = sum(k for _, _, k in tiles) / len(item)
                if tiles and coverage >= share:
                    rows.append((digest.as_py(), item_id.as_py(), coverage, len(tiles), max(k for _, _, k in tiles)))
            cols = list(zip(*rows)) or [[] for _ in range(5)]
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["digest", "item_id", "coverage", "n_tiles", "longest_tile"])

    return pairs.mapInArrow(run, "digest string, item_id long, coverage double, n_tiles int, longest_tile int")


def leaked_texts(docs: DataFrame, benchmark: DataFrame, least: int, share: float, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """Of documents (doc_id, text): those with seeds, and of each leaking text (by its MD5 digest) a row an item. Equal texts are tiled once."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    items = scratch.table(benchmark_items(benchmark, least, item_col, item_text_col), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # ``least`` numbers at most
    n_seeds = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    known = None
    if n_seeds <= FILTER_SEEDS:
        known = np.sort(items.select(F.explode("seeds").alias("s")).distinct().toPandas()["s"].to_numpy(dtype=np.int64).view(np.uint64))
    hits = scratch.table(seed_hits(docs, widths if n_seeds else [], known), "hits")
    texts = scratch.table(hits.dropDuplicates(["digest"]), "texts")
    seeds = items.select("item", F.explode(F.arrays_zip("seeds", "times")).alias("x")).select("item", F.col("x.seeds").alias("seed"), F.col("x.times").alias("times"))
    pairs = (
        texts.select("digest", F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .groupBy("digest", "item")
        .agg(F.sum("times").alias("seeded"))
        .join(items.select("item", "item_id", "n", "width", "words"), "item")
        .filter(F.col("seeded") * F.col("width") >= share * F.col("n"))  # no more words than these can be under tiles
        .join(texts.select("digest", "part"), "digest")
    )
    return hits, scratch.table(tiled(pairs, share), "leaks")


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = 5,
    share: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row per document row and benchmark item of which the document holds ``share`` of the words or more.

    Columns: doc_id, item_id, coverage, n_tiles, longest_tile. Words are compared without ASCII case and edge
    punctuation. Items shorter than ``least`` words are seeded and tiled whole.

    Ids are of an integer type. Null or empty texts on either side leak nothing. Very long texts are tiled whole. Ties: a coverage
    equal to ``share`` is a leak; of common runs of one length the first in the item, then in the document, is marked first. Repeated
    rows, null ids and equal items give a row each. An empty table on either side gives an empty result. Other columns are
    ignored, whatever their names.
    """
    source = docs.select(long_id(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    hits, leaks = leaked_texts(source, benchmark, least, share, item_col, item_text_col)
    return hits.select("doc_id", "digest").join(leaks, "digest").drop("digest")


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows that hold ``share`` or more of a benchmark item.

    Null and empty texts stay, as do all rows where either table is empty. Repeated rows go or stay together; very long texts are tiled
    whole; a coverage equal to ``share`` is a leak. Ids don't matter, and all columns pass through, whatever their names.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col(f"`{text_col}`")
    _, leaks = leaked_texts(docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")), benchmark, least, share, item_col, item_text_col)
    gone = leaks.select(F.col("digest").alias("__lw_digest")).distinct()
    return docs.withColumn("__lw_digest", F.md5(text.cast("binary"))).join(gone, "__lw_digest", "left_anti").select(*names)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
