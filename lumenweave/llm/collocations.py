"""Operator 12: phrase collocation mining by hashed buckets (PCY, DHP).

Pass k counts the phrases of k words that may be frequent, and beside that counts phrases of k + 1 words by hash bucket. The buckets that reach the least
count come back as a bitmap, so do the frequent phrases of k words; pass k + 1 counts a phrase only if its bucket's bit is set (DHP) and both phrases of k words in it
are frequent (Apriori). Bitmaps have no misses, only phrases too many, and what they let through is counted exactly: they save work and decide nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, mix64, read_table, ship_package, tidy, word_hashes

CHUNK = 16 << 20  # bytes of text whose phrases are counted together in a task
BUCKETS = 1 << 22  # of phrases one word longer; a task sends a byte for each
BLOCK = 1 << 16  # buckets that travel in a row
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26  # of the bitmap of frequent phrases: 16 a phrase between these
RANK_PARTS = 64  # of a group, ranked each before their best are

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(10 if b in _BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "grp string, phrase binary, h long, n long, block int, sums binary"


def _parts(text: bytes):
    """A text in stretches of about a chunk, cut where a piece ends: no phrase crosses that."""
    at = 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(bytes([b]), at, at + CHUNK) for b in _BREAKS)
        if cut <= at:
            cut = min((k for b in _BREAKS if (k := text.find(bytes([b]), at + CHUNK)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


class Words:
    """The words of a chunk of texts: their codes in the chunk's own dictionary, the piece that each is in, and its group."""

    def __init__(self, texts: list[bytes], groups: list[int], names: list[str]):
        raw = b"\n".join(texts).translate(_FOLD)
        buf = np.frombuffer(raw, dtype=np.uint8)
        inside = np.zeros(len(buf) + 2, dtype=bool)
        np.greater((buf != 32) & (buf != 10), 0, out=inside[1:-1])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = turns[0::2], turns[1::2]
        self.n = len(start)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.group = np.asarray(groups, dtype=np.int64)[np.searchsorted(starts, start, side="right") - 1]
        self.seed = np.array([_seed(name) for name in names], dtype=np.uint64)[self.group]
        self.piece = np.searchsorted(np.flatnonzero(buf == 10), start)
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside[1:-1]])])
        coded = packed.dictionary_encode()
        self.names = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.hash = word_hashes(b" ".join(self.names.to_pylist()), lower=False)[0][self.code] if self.n else np.zeros(0, dtype=np.uint64)

    def starts(self, k: int, of: np.ndarray | None = None) -> np.ndarray:
        """Where a phrase of k words begins, among the places given."""
        of = np.arange(self.n) if of is None else of
        of = of[of + k <= self.n]
        return of[self.piece[of] == self.piece[of + k - 1]]

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        h = self.seed[at]
        for j in range(k):
            h = mix64(h * _STEP + self.hash[at + j])
        return h

    def counted(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place of each different phrase that begins at the places given, and how many are like it; exact."""
        of = self.group[at]
        for j in range(k):
            keys = pa.array(of * len(self.names) + self.code[at + j]).dictionary_encode()
            of = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.zeros(len(keys.dictionary), dtype=np.int64)
        first[of[::-1]] = at[::-1]
        return first, np.bincount(of, minlength=len(first))

    def phrases(self, k: int, at: np.ndarray) -> pa.Array:
        words = [self.names.take(pa.array(self.code[at + j])) for j in range(k)]
        return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if k > 1 else words[0]


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set in a bitmap of a power of two of bits."""
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _seed(name: str) -> np.uint64:
    """A group's part in the hashes of its phrases, the same in every task."""
    return word_hashes(b"g" + name.encode().hex().encode())[0][0]


def _pass(docs: DataFrame, k: int, longest: int, least: int, frequent: np.ndarray | None, buckets: np.ndarray | None) -> DataFrame:
    """Rows of phrases of k words with their count in a chunk, and rows of bucket counts of a task for k + 1 words, each at most ``least``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((frequent, buckets)) if k > 1 else None
    small = np.uint8 if least < 256 else np.uint32

    def run(batches):
        frequent, buckets = sent.value if sent is not None else (None, None)
        sums = np.zeros(BUCKETS, dtype=np.int64) if k < longest else None

        def candidates(words: Words, width: int, at: np.ndarray) -> np.ndarray:
            """Those of the places where both shorter phrases are frequent and the bucket is."""
            for j in (0, 1):
                at = at[_has(frequent, words.hashes(width - 1, at + j))]
            return at[_has(buckets, words.hashes(width, at))]

        def rows(texts: list[bytes], groups: list[str]):
            names = sorted(set(groups))
            words = Words(texts, [names.index(g) for g in groups], names)
            at = words.starts(k)
            if k > 1:
                at = candidates(words, k, at)
            if k < longest:
                # the longer phrase's two parts must be candidates here, or it can't be frequent
                mine = np.zeros(words.n + 1, dtype=bool)
                mine[at] = True
                more = words.starts(k + 1, at)
                more = more[mine[more + 1]]
                sums[:] += np.bincount((words.hashes(k + 1, more) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                np.minimum(sums, least, out=sums)
            if len(at):
                first, n = words.counted(k, at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(names, dtype=object)[words.group[first]], pa.string()), words.phrases(k, first).cast(pa.binary()),
                    pa.array(words.hashes(k, first).view(np.int64)), pa.array(n, pa.int64()), pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.binary()),
                ], names=["grp", "phrase", "h", "n", "block", "sums"])

        texts, groups, size = [], [], 0
        for b in batches:
            for group, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for part in _parts(text):
                    if size and size + len(part) > CHUNK:
                        yield from rows(texts, groups)
                        texts, groups, size = [], [], 0
                    texts.append(part)
                    groups.append(group)
                    size += len(part) + 1
        if texts:
            yield from rows(texts, groups)
        if sums is not None and sums.any():
            blocks = [(i, part.astype(small).tobytes()) for i, part in enumerate(sums.reshape(-1, min(BLOCK, BUCKETS))) if part.any()]
            m = len(blocks)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(m, pa.string()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                pa.array([i for i, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary()),
            ], names=["grp", "phrase", "h", "n", "block", "sums"])
        tidy()

    return docs.mapInArrow(run, _ROWS)


def _bucket_bits(rows: DataFrame, least: int) -> np.ndarray:
    """The bitmap of buckets that reach the least count: tasks' sums are added up block by block as they stream by."""
    small, width = np.uint8 if least < 256 else np.uint32, min(BLOCK, BUCKETS)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(sums, dtype=small).astype(np.int64)
                total[block] = np.minimum(total.get(block, 0) + own, least)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(total), pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in total.values()], pa.binary()),
        ], names=["block", "bits"])

    summed = rows.filter("block is not null").select("block", "sums").repartition(BUCKETS // width, "block").mapInArrow(run, "block int, bits binary")
    out = np.zeros(BUCKETS // 8, dtype=np.uint8)
    for r in summed.collect():  # BUCKETS / 8 bytes in all
        out[r.block * width // 8 : (r.block + 1) * width // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _frequent_bits(found: DataFrame, count: int) -> np.ndarray:
    """A bitmap of the frequent phrases' hashes: 16 bits a phrase, within bounds."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count - 1).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = found.groupBy((F.shiftright(at, 5)).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("b"))
    got = words.toArrow()  # bits / 32 rows at most
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def frequent_phrases(scratch: Scratch, docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words that occur ``least`` times in a group (grp, k, phrase, f), and each group's number of words (grp, total)."""
    found, totals = [], None
    frequent = buckets = None
    for k in range(1, longest + 1):
        rows = scratch.table(_pass(docs, k, longest, least, frequent, buckets), f"pass{k}")
        counted = rows.filter("block is null").groupBy("grp", "phrase").agg(F.sum("n").alias("f"), F.first("h").alias("h"))
        if k == 1:
            totals = scratch.table(rows.filter("block is null").groupBy("grp").agg(F.sum("n").alias("total")), "totals")
        table = scratch.table(counted.filter(F.col("f") >= least).withColumn("k", F.lit(k)), f"frequent{k}")
        found.append(table)
        count = table.count()
        if k < longest and count:
            buckets = _bucket_bits(rows, least)
            frequent = _frequent_bits(table, count)
        scratch.drop(f"pass{k}")
        if not count:
            break
    return reduce(DataFrame.unionByName, found).select("grp", "k", F.col("phrase").cast("string").alias("phrase"), "f"), totals


def collocations(
    docs: DataFrame, *, text_col: str = "text", group_col: str | None = "lang", no_group: str = "und", longest: int = 5, least: int = 100,
    contained: int = 100, top: int = 2000,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each group by how much oftener they occur than their parts would together by chance.

    Columns grp, rank (from 1), phrase, a, l, r, n, score. A-Z count as a-z; phrases don't cross ``[.,;:!?]`` or a line end. a, l and r count the phrase and the two parts
    of the cut that scores least (ties: the shorter first part), n the group's words; score is floor(1000 * a * n / (l * r)), exact. A phrase of less than
    ``least`` occurrences is none; one inside a longer phrase that has ``contained`` percent of its occurrences is left out. Ties go by a and then by
    the phrase's bytes. A null group is ``no_group``, a null text is empty, repeated rows count each time; texts are counted whole, an empty table
    gives an empty one, and only the two named columns are read, whatever else there is.
    """
    if longest < 2 or least < 1 or least >= 1 << 31:
        raise ValueError("phrases have two words or more, and occur once or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    group = F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit(no_group)) if group_col else F.lit(no_group)
    texts = docs.select(group.alias("grp"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    found, totals = frequent_phrases(scratch, texts, longest, least)

    words = found.filter("k > 1").withColumn("w", F.split("phrase", " "))
    joined = lambda a, n: F.concat_ws(" ", F.slice("w", a, n))
    cuts = words.select("grp", "phrase", "w", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("grp", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("head"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    part = lambda name, n: found.select("grp", F.col("phrase").alias(name), F.col("f").alias(n))
    whole = cuts.join(part("head", "l"), ["grp", "head"]).join(part("rest", "r"), ["grp", "rest"]).join(totals.withColumnRenamed("total", "n"), "grp")
    score = F.expr("cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = whole.groupBy("grp", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "a", "n")).alias("b")).select("grp", "phrase", "b.*")

    inner = words.filter("k > 2").select("grp", "w", "k", "f", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    inner = inner.select("grp", "w", "f", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("from"))
    inner = inner.groupBy("grp", joined(F.col("from"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["grp", "phrase"], "left").filter(f"longer is null or 100 * longer < {contained} * a")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = F.row_number().over(Window.partitionBy("grp", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order))
    last = F.row_number().over(Window.partitionBy("grp").orderBy(*order))
    ranked = kept.withColumn("rank", first).filter(F.col("rank") <= top).withColumn("rank", last).filter(F.col("rank") <= top)
    return ranked.select("grp", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return collocations(read_table(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")
