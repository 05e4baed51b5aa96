"""Operator 4: a quality classifier on random-indexing word vectors.

Every word of the vocabulary (the commonest words of all documents, a stated number of them) and every word
shape has a sparse random index vector; its context vector is the sum of its neighbours' index vectors over the
whole corpus. These are sums of integers, so they don't depend on the order of tasks. A document is the mean of its
words' normalised context vectors; a two-layer network learns the label from a bounded sample of labelled
rows, and a temperature fitted on rows it didn't learn from calibrates it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, crc_of_id, cut_text, mix64, read_table, ship_package, tidy, word_hashes

VOCABULARY, SHAPES = 1 << 15, 1 << 12  # words with a vector of their own, at most; hashed rows of word shapes
ROWS = VOCABULARY + SHAPES
DIM, NONZERO, REACH = 64, 2, 2  # width, entries of an index vector, neighbours each side
BLOCK = 1024  # rows of the table that travel together
MERGE = 32  # partial tables that one task adds up at a time
FLUSH = 400_000  # tokens that a task gathers before it adds them up
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Classes of a shape's bytes: 1 of A-Z, 2 of a-z and all above ASCII, 3 of digits, 0 of white space, others by themselves below 0.
_CLASSES = np.array(
    [1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else 0 if b in (9, 10, 11, 12, 13, 32) else -1 - b for b in range(256)], dtype=np.int16
)


def core_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of a text's words in small letters without ASCII punctuation at their ends (with it where nothing else is left)."""
    return word_hashes(text, True, EDGE)[0]


def shape_rows(text: bytes | None) -> np.ndarray:
    """The row of each word's shape: its bytes' classes, of which runs count once, the first eight."""
    rows = []
    for piece in cut_text(text or b""):
        c = _CLASSES[np.frombuffer(piece, dtype=np.uint8)]
        word = np.concatenate([[False], c != 0, [False]])
        turn = np.flatnonzero(word[1:] != word[:-1])
        start, end = turn[0::2], turn[1::2]
        if not len(start):
            continue
        # kept: a word's first byte, and those that aren't letters or digits like the byte before
        kept = word[1:-1].copy()
        kept[1:] &= (c[1:] != c[:-1]) | (c[1:] < 0)
        at = np.flatnonzero(kept)
        first = np.searchsorted(at, start)
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        at, rank = at[rank < 8], rank[rank < 8]
        with np.errstate(over="ignore"):
            part = mix64(c[at].astype(np.int64).view(np.uint64) * np.uint64(16) + rank.astype(np.uint64))
            total = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
            h = total[np.searchsorted(at, end)] - total[np.searchsorted(at, start)]
        rows.append(VOCABULARY + (mix64(h) % np.uint64(SHAPES)).astype(np.int64))
    return np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)


class WordRows:
    """A text's words and shapes as rows of the table. ``vocabulary``: the words' hashes by row."""

    def __init__(self, vocabulary: np.ndarray):
        self.order = np.argsort(vocabulary)
        self.sorted = vocabulary[self.order]

    def tokens(self, text: bytes | None) -> np.ndarray:
        """Rows of a text's words (-1 for one without) and shapes, in turn."""
        h = core_hashes(text)
        out = np.empty(2 * len(h), dtype=np.int64)
        out[1::2] = shape_rows(text)
        out[0::2] = -1
        if len(self.sorted) and len(h):
            k = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            out[0::2] = np.where(self.sorted[k] == h, self.order[k], -1)
        return out


def common_words(docs: DataFrame, text_col: str) -> np.ndarray:
    """Hashes of the VOCABULARY commonest words of all documents: by sixteenths of a power of two of their counts, then by hash."""

    def run(batches):
        held, n = [], 0
        u, c = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

        def add():
            every, back = np.unique(np.concatenate([u, *held]), return_inverse=True)
            return every, np.bincount(back, weights=np.concatenate([c, np.ones(n, dtype=np.int64)]), minlength=len(every)).astype(np.int64)

        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                h = core_hashes(text.as_py())
                if len(h):
                    held.append(h)
                    n += len(h)
                if n >= FLUSH:
                    u, c = add()
                    held, n = [], 0
                    if len(u) >= FLUSH:
                        yield pa.RecordBatch.from_pydict({"h": u.view(np.int64), "n": c})
                        u, c = u[:0], c[:0]
        if held:
            u, c = add()
        yield pa.RecordBatch.from_pydict({"h": u.view(np.int64), "n": c})
        del u, c, held
        tidy()

    # every sixteenth of a power of two is a level of commonness: 1024 of them at most
    counted = docs.select(text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    levels = counted.select("h", F.floor(16 * F.log2("n")).cast("int").alias("level"))
    scratch = Scratch(docs.sparkSession, "vocabulary")
    levels = scratch.table(levels, "levels")
    left, last, share = VOCABULARY, -1, 1.0
    for r in sorted(levels.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        last, share = r["level"], min(1.0, 1.2 * (left + 100) / r["count"])
        left -= r["count"]
        if left <= 0:
            break
    near = F.pmod(F.xxhash64("h"), F.lit(1 << 31))
    kept = levels.filter((F.col("level") > last) | ((F.col("level") == last) & (near <= int(share * (1 << 31)))))
    rows = kept.orderBy(F.col("level").desc(), near, "h").limit(VOCABULARY).select("h").toPandas()
    scratch.drop("levels")
    return rows["h"].to_numpy(dtype=np.int64).view(np.uint64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's random index vector: the same everywhere."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, DIM, (ROWS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (ROWS, NONZERO))


def add_contexts(table: np.ndarray, docs: list[np.ndarray], place: np.ndarray, sign: np.ndarray) -> None:
    """Add to each token's row the index vectors of its neighbours; documents don't touch."""
    gap = np.full(REACH, -1, dtype=np.int64)
    seq = np.concatenate([x for d in docs for x in (d, gap)])
    flat = table.reshape(-1)
    for o in range(1, REACH + 1):
        a, b = seq[:-o], seq[o:]
        ok = (a >= 0) & (b >= 0)
        a, b = a[ok], b[ok]
        for k in range(NONZERO):
            # sums of -1 and 1: whole numbers, which doubles hold exactly in any order
            flat += np.bincount(a * DIM + place[b, k], weights=sign[b, k], minlength=ROWS * DIM)
            flat += np.bincount(b * DIM + place[a, k], weights=sign[a, k], minlength=ROWS * DIM)


def _sum_blobs(key):
    def run(table: pa.Table) -> pa.Table:
        total = 0
        for blob in table.column("part"):
            total = total + np.frombuffer(zlib.decompress(blob.as_buffer()), dtype=np.int64)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in key}, "part": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    return run


def context_table(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> np.ndarray:
    """The context vectors over all documents, ROWS x DIM, unit length: its size is fixed.

    Each task sums its own table; tables are added in rounds of MERGE, so that no task gathers more than
    MERGE blocks of fixed size however many tasks there are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        from pyspark import TaskContext

        rows, (place, sign) = WordRows(shared.value), index_vectors()
        table, held, n, any_text = np.zeros((ROWS, DIM)), [], 0, False
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                d = rows.tokens(text.as_py())
                if len(d):
                    held.append(d)
                    n += len(d)
                if n >= FLUSH:
                    add_contexts(table, held, place, sign)
                    held, n, any_text = [], 0, True
        if held:
            add_contexts(table, held, place, sign)
            any_text = True
        if any_text:
            part = TaskContext.get().partitionId()
            parts = [zlib.compress(table[k : k + BLOCK].astype(np.int64).tobytes(), 1) for k in range(0, ROWS, BLOCK)]
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(range(len(parts)), pa.int32()), "task": pa.array([part] * len(parts), pa.int32()), "part": pa.array(parts, pa.binary())}
            )
        del table, rows
        tidy()

    source = docs.select(text_col)
    tasks = max(1, source.rdd.getNumPartitions())
    sums = source.mapInArrow(run, "block int, task int, part binary")
    while tasks > 1:
        sums = sums.withColumn("task", (F.col("task") / MERGE).cast("int")).groupBy("block", "task").applyInArrow(_sum_blobs(["block", "task"]), "block int, task int, part binary")
        tasks = -(-tasks // MERGE)
    table = np.zeros((ROWS, DIM))
    for r in sums.collect():  # ROWS / BLOCK rows
        part = np.frombuffer(zlib.decompress(bytes(r["part"])), dtype=np.int64)
        table[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = part.reshape(-1, DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, norm, out=np.zeros_like(table), where=norm > 0).astype(np.float32)


def pooled(docs: DataFrame, text_col: str, vocabulary: np.ndarray, table: np.ndarray) -> DataFrame:
    """``docs`` without the text, with ``vector``: the mean of its tokens' context vectors (zeros without words)."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, table))
    at = docs.columns.index(text_col)
    schema = docs.drop(text_col).schema.add("vector", T.ArrayType(T.FloatType()))

    def run(batches):
        rows, t = WordRows(shared.value[0]), shared.value[1]
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                out = np.zeros((part.num_rows, DIM), dtype=np.float32)
                for i, text in enumerate(part.column(at).cast(pa.binary())):
                    d = rows.tokens(text.as_py())
                    d = d[d >= 0]
                    if len(d):
                        seen, times = np.unique(d, return_counts=True)
                        out[i] = times.astype(np.float32) @ t[seen] / len(d)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, DIM, dtype=np.int32)), pa.array(out.ravel()))
                rest = [c for j, c in enumerate(part.columns) if j != at]
                yield pa.RecordBatch.from_arrays([*rest, vectors], names=[*(n for j, n in enumerate(part.schema.names) if j != at), "vector"])
        del rows, t
        tidy()

    return docs.mapInArrow(run, schema)


@dataclass
class Network:
    """Standardised input, one hidden layer, a logit, and a temperature that divides it."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the log loss with rare classes weighted up half-way; a fifth of the rows sets the temperature only."""
    rng = np.random.default_rng(seed)
    if not len(x) or y.min() == y.max():  # nothing to tell apart
        p = (y.sum() + 1) / (len(y) + 2)
        z = np.zeros((DIM, 1))
        return Network(np.zeros(DIM), np.ones(DIM), z, np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    order = rng.permutation(len(x))
    kept = order[: max(1, len(x) // 5)] if len(x) >= 20 else order
    learn = order[len(x) // 5 :] if len(x) >= 20 else order
    net = Network(x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6, rng.normal(0, np.sqrt(2 / DIM), (DIM, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), 0.0)
    share = y[learn].mean()
    weight = np.where(y == 1, (0.5 / max(share, 1e-6)) ** 0.5, (0.5 / max(1 - share, 1e-6)) ** 0.5)
    state = [np.zeros_like(np.asarray(p, dtype=float)) for p in (net.w1, net.b1, net.w2, net.b2)]
    second = [s.copy() for s in state]
    step = 0
    for _ in range(epochs):
        for k in np.array_split(rng.permutation(learn), max(1, len(learn) // 256)):
            a = (x[k] - net.mean) / net.scale
            pre = a @ net.w1 + net.b1
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -50, 50)))
            d = (p - y[k]) * weight[k] / len(k)
            dh = np.outer(d, net.w2) * (pre > 0)
            grads = [a.T @ dh + decay * net.w1, dh.sum(axis=0), h.T @ d + decay * net.w2, d.sum()]
            step += 1
            params = [net.w1, net.b1, net.w2, net.b2]
            for i, g in enumerate(grads):
                state[i] = 0.9 * state[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3])
    logit = net.logit(x[kept])
    loss = lambda t: np.logaddexp(0, np.where(y[kept] == 1, -logit, logit) / t).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    may_teach,
    max_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Per row of ``docs``: the id and ``score``, the probability of label 1.

    ``may_teach`` is a condition on the id: only labels of such rows are read. Of them at most ``max_rows``
    (those of least hash of the id) teach the network; word vectors come from all documents. A null or empty
    text has the zero vector, and so a score; a very long one is pooled whole. An id with several labels teaches with each; null labels and ids don't.
    Words equally common come into the vocabulary by hash. Repeated rows and null ids come back as they are; equal texts have equal scores. Without
    labels all scores are a half; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark, "quality")
    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    vocabulary = common_words(source, "__text")
    vectors = scratch.table(pooled(source, "__text", vocabulary, context_table(source, "__text", vocabulary)), "vectors")
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y"))
    taught = vectors.join(known.filter(may_teach(F.col("__id"))), "__id").withColumn("h", F.pmod(F.xxhash64("__id"), F.lit(1 << 31)))
    # a cut at the hash that a fifth more rows than wanted lie below, so that each task sends few to the last sort
    share = min(1.0, 1.2 * (max_rows + 100) / max(taught.count(), 1))
    sample = taught.filter(F.col("h") <= int(share * (1 << 31))).orderBy("h", "__id", "y").limit(max_rows).select("vector", "y").toPandas()
    x = np.array(sample["vector"].tolist(), dtype=np.float64).reshape(-1, DIM)
    net = spark.sparkContext.broadcast(fit_network(x, sample["y"].to_numpy(dtype=np.float64)))

    def run(batches):
        for b in batches:
            v = b.column(1)
            flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.value.probability(flat.astype(np.float64)))], names=["__id", "score"])

    kind = vectors.schema["__id"].dataType.simpleString()
    return vectors.select("__id", "vector").mapInArrow(run, f"__id {kind}, score double").withColumnRenamed("__id", id_col)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = lambda c: F.pmod(crc_of_id(c), F.lit(3)) == 1
    scored = score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), lambda c: ~third(c))
    return scored.select(
        "doc_id", F.coalesce(third(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
