"""Operator 6: best-fit packing by the linear grouping scheme.

Only how many pieces there are of each length matters for how they share sequences, and lengths are
bounded by the sequence's. So the plan is made on the driver from that histogram (at most ``capacity``
numbers, whatever the corpus): lengths above a limit are grouped by equal numbers of pieces and rounded
up to the group's largest, a linear program over sequence configurations of these few sizes is solved by
column generation, actual lengths take the rounded ones' places, and what is left (small lengths, and
the remainder of rounding the program's solution) goes by best fit into the gaps. Sequences of one
shape are one entry with a count. Pieces then find their place by rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, long_id, read_table, ship_package

# --- the plan -------------------------------------------------------------------------------------


def _best_config(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration (how many of each size) of most worth that fits: an unbounded knapsack, a layer an item."""
    best, came = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    useful = [k for k in np.argsort(-worth / sizes).tolist() if worth[k] > 0]
    for _ in range(capacity // int(sizes.min())):
        changed = False
        for k in useful:
            got = best[: capacity + 1 - sizes[k]] + worth[k]
            more = got > best[sizes[k] :] + 1e-12
            if more.any():
                best[sizes[k] :][more] = got[more]
                came[sizes[k] :][more] = k
                changed = True
        if not changed:
            break
    config, room = np.zeros(len(sizes), dtype=np.int64), int(best.argmax())
    while came[room] >= 0:
        k = int(came[room])
        config[k] += 1
        room -= int(sizes[k])
    return float(config @ worth), config


def solve_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each: the linear program's optimum, by column generation."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for _ in range(most):
        worth = inverse.sum(axis=0)
        value, config = _best_config(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ config
        ratio = np.where(step > 1e-10, x / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        columns[:, out] = config
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    return [(columns[:, j].astype(np.int64), float(x[j])) for j in range(m) if x[j] > 1e-9]


class _Shapes:
    """Sequences by what they hold: (lengths, count), findable by how much room they have."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.at = capacity, [], {}

    def add(self, held: tuple[int, ...], room: int, count: int) -> None:
        if count:
            if room not in self.at:
                insort(self.rooms, room)
                self.at[room] = []
            self.at[room].append((held, count))

    def take(self, least: int):
        """A shape with the smallest room of at least ``least``."""
        k = bisect_left(self.rooms, least)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        held, count = self.at[room].pop()
        if not self.at[room]:
            del self.at[room]
            self.rooms.pop(k)
        return held, room, count

    def all(self):
        return [(held, count) for room in self.rooms for held, count in self.at[room]]


def plan_shapes(histogram: dict[int, int], capacity: int, groups: int = 48, small: float = 1 / 8) -> list[tuple[tuple[int, ...], int]]:
    """Shapes (lengths of a sequence's pieces, how many such sequences) that hold the histogram exactly."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    shapes = _Shapes(capacity)
    if full := left.pop(capacity, 0):
        shapes.add((capacity,), 0, full)
    large = sorted((k for k in left if k > small * capacity), reverse=True)
    total = sum(left[k] for k in large)
    if total:
        # equal numbers of pieces a group, largest first; a length may be shared by two groups
        bounds = [round(total * (i + 1) / groups) for i in range(groups)]
        parts: list[list[list[int]]] = [[] for _ in range(groups)]
        done, g = 0, 0
        for k in large:
            n = left[k]
            while n:
                while bounds[g] <= done:
                    g += 1
                took = min(n, bounds[g] - done)
                parts[g].append([k, took])
                done += took
                n -= took
        parts = [p for p in parts if p]
        sizes = np.array([p[0][0] for p in parts])
        demand = np.array([sum(n for _, n in p) for p in parts], dtype=float)
        # groups of one rounded size are one row of the program
        kinds, row = np.unique(sizes, return_inverse=True)
        need = np.bincount(row, weights=demand)
        queues: list[list[list[int]]] = [[] for _ in kinds]
        for p, r in zip(parts, row):
            queues[r] += p
        for config, times in sorted(solve_configurations(kinds, need, capacity), key=lambda c: -int(c[0] @ kinds)):
            times = int(times + 1e-9)
            for r in np.flatnonzero(config):
                times = min(times, sum(n for _, n in queues[r]) // int(config[r]))
            slots = [r for r in np.flatnonzero(config)[::-1] for _ in range(config[r])]
            # substitute actual lengths: each slot takes the next ``times`` pieces of its group
            runs = []
            for r in slots:
                taken, want = [], times
                while want:
                    k, n = queues[r][0]
                    took = min(n, want)
                    taken.append((k, took))
                    want -= took
                    if took == n:
                        queues[r].pop(0)
                    else:
                        queues[r][0][1] -= took
                runs.append(taken)
            at, heads = 0, [[0, 0] for _ in runs]  # per slot: run, used of it
            while at < times:
                span = min(run[h[0]][1] - h[1] for run, h in zip(runs, heads))
                held = tuple(run[h[0]][0] for run, h in zip(runs, heads))
                shapes.add(held, capacity - sum(held), span)
                for run, h in zip(runs, heads):
                    h[1] += span
                    if h[1] == run[h[0]][1]:
                        h[0], h[1] = h[0] + 1, 0
                at += span
        for k in large:
            left.pop(k)
        for q in queues:
            for k, n in q:
                left[k] = left.get(k, 0) + n
    for k in sorted(left, reverse=True):  # best fit for what is left
        n = left[k]
        while n:
            got = shapes.take(k)
            if got is None:
                each = capacity // k
                if n >= each:
                    shapes.add((k,) * each, capacity - each * k, n // each)
                    n %= each
                else:
                    shapes.add((k,) * n, capacity - n * k, 1)
                    n = 0
                continue
            held, room, count = got
            if n < count:
                shapes.add(held, room, count - n)
                count = n
            each = max(1, min(room // k, n // count))
            shapes.add(held + (k,) * each, room - each * k, count)
            n -= each * count
    return shapes.all()


#: (groups, small) of the scheme: how finely large lengths are grouped, and up to which share of a sequence a length is small.
SETTINGS = ((48, 1 / 3), (24, 1 / 4), (96, 1 / 4), (200, 1 / 4), (48, 1 / 8))


def best_plan(histogram: dict[int, int], capacity: int, settings=SETTINGS) -> list[tuple[tuple[int, ...], int]]:
    """The scheme at each setting until one reaches the volume bound; the plan of fewest sequences."""
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    best, fewest = [], None
    for groups, small in settings:
        shapes = plan_shapes(histogram, capacity, groups, small)
        n = sum(count for _, count in shapes)
        if fewest is None or n < fewest:
            best, fewest = shapes, n
        if fewest == least:
            break
    return best


class Places:
    """Where the piece of a rank within its length goes: runs of ranks to (first sequence, offset)."""

    def __init__(self, shapes):
        by: dict[int, list[tuple[int, int, int]]] = {}
        ranks: dict[int, int] = {}
        base = 0
        for held, count in shapes:
            offset = 0
            for k in held:
                r = ranks.get(k, 0)
                by.setdefault(k, []).append((r, base, offset))
                ranks[k] = r + count
                offset += k
            base += count
        self.sequences = base
        self.by = {k: np.array(v, dtype=np.int64) for k, v in by.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
        for k in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == k)
            table = self.by[k]
            run = np.searchsorted(table[:, 0], ranks[own], side="right") - 1
            sequence[own] = table[run, 1] + ranks[own] - table[run, 0]
            offset[own] = table[run, 2]
        return sequence, offset


# --- tokens ---------------------------------------------------------------------------------------


PUNCTUATION = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~>"  # without ' (it opens tokens) and < (it opens special tokens)
LETTERS_PATTERN = "[\\p{L}]+"


def _byte_stand_ins() -> dict[int, str]:
    from .token_counts import byte_letters

    return {b: c for c, b in byte_letters().items()}


class WordIds(dict):
    """word bytes (A-Z lowered) -> its ids as little-endian unsigned 32-bit numbers, remembered up to ``limit`` words.

    White space in ASCII always separates tokens here, so a text's ids are its words' ids in order. A
    run of small Latin letters, and of ASCII punctuation behind it, is a token of its own to a tokenizer
    that splits by letters and marks byte-level word ends: such words go straight to its merge model.
    All others are encoded whole.
    """

    def __init__(self, path: str, limit: int = 500_000):
        import json

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.simple = (
            [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and LETTERS_PATTERN in steps[0]["pattern"].get("Regex", "").split("|")
            and not steps[1]["add_prefix_space"]
            and normal == ["NFC", "Replace", "Lowercase"]
            and spec["post_processor"] is None
        )
        self.model, self.stand_ins, self.marks = self.tokenizer.model, _byte_stand_ins(), {b"": b""}

    def _merge(self, piece: bytes) -> bytes:
        text = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.stand_ins)
        return np.array([t.id for t in self.model.tokenize(text)], dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        core = word.rstrip(PUNCTUATION)
        tail = word[len(core) :]
        if self.simple and (not core or core.isalpha() or _small_latin(core)):
            if tail not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {b"": b""}
                self.marks[tail] = self._merge(tail)
            # the merge model normalises nothing, and words of a text with < come as they are
            ids = (self._merge(core.lower()) if core else b"") + self.marks[tail]
        else:
            ids = np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        # the tokenizer lowers case itself, but knows its special tokens by exact case
        words = (text if b"<" in text else text.lower()).split()
        return b"".join(map(self.__getitem__, words))


def _small_latin(word: bytes) -> bool:
    """Letters below U+0250 only, small ones: their own normal form and lower case."""
    s = word.decode("utf-8", "replace")
    return s.isalpha() and max(s) < "\u0250" and s.lower() == s


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memory of words a Python worker, which later tasks of that worker use on."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int | None) -> DataFrame:
    """A row per piece of each row's ids, with its number among the task's pieces of that length."""

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part = word_ids(tokenizer), TaskContext.get().partitionId()
        close = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                rows = []
                chunk = b.slice(k, 1024)
                for doc, text in zip(chunk.column(0).to_pylist(), chunk.column(1).cast(pa.binary())):
                    text = text.as_py()
                    ids = (words.encode(text) if text else b"") + close
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, piece, at // 4, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                cols = list(zip(*rows)) or [[] for _ in range(7)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"],
                )

    return docs.select(long_id(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, PIECES)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 1,
    scratch: Scratch | None = None,
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A row's ids are its text's (null: none), then ``end_id``; only longer ones are cut, into pieces of
    ``capacity`` ids. No row is dropped: a null or empty text is a piece of the end id alone, a very long one many pieces. Repeated rows
    and null ids are packed like any other. Ids are of an integer type. Pieces of one length are alike to the plan; which of them goes
    where follows the order in which tasks read them. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark, "packing")
    pieces = scratch.table(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # a row a task and length: ranks of a length run on from task to task
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(best_plan(histogram, capacity)))

    def put(batches):
        for b in batches:
            s, o = places.value.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(s), pa.array(o)], names=[*b.schema.names[:-1], "sequence_id", "offset"]
            )

    ranked = pieces.join(first.drop("n"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank_in_part")).alias("rank")
    )
    return ranked.mapInArrow(
        put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
