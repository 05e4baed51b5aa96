"""Shared plumbing of the corpus operators: scratch tables, Arrow mapping, words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenweave.session import shared_folder
from lumenweave.session import ship_package as ship

BATCH_ROWS = 1024  # rows that travel to Python together: whole texts may be long


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, and batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder: they cut lineage, and a lost executor costs no recomputation.

    ``table`` writes and rereads a frame; ``drop`` deletes one that no later plan reads. What the
    returned result still reads stays until the application's checkpoint folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark, self.dir = spark, shared_folder(spark, f"lumenweave-{name}")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        # what the write shuffled is of no more use behind it: its files go at once, not when the driver next collects garbage
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        conf.set(key, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def tidy() -> None:
    """Give a task's freed memory back to the system: a Python worker lives on for other tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def annotate(df: DataFrame, text_col: str, make, added: T.StructType) -> DataFrame:
    """``df`` with the ``added`` columns, computed in Arrow batches from the UTF-8 bytes of ``text_col``.

    Columns that have a name of an added one are replaced; the text column's own name can't be one.
    ``make()`` runs once in each task and returns a function from a list of bytes or None (one an
    input row) to a list of columns. Every other column passes through as Arrow data untouched.
    """
    if text_col in added.fieldNames():
        raise ValueError(f"the text column can't be named {text_col}: a result has that name")
    df = df.drop(*[c for c in df.columns if c in added.fieldNames()])
    out = T.StructType(list(df.schema.fields) + list(added.fields))
    at = df.columns.index(text_col)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fn, arrow = make(), to_arrow_schema(added)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                cols = fn(part.column(at).cast(pa.binary()).to_pylist())
                arrays = [pa.array(c, type=f.type) for c, f in zip(cols, arrow)]
                yield pa.RecordBatch.from_arrays(
                    list(part.columns) + arrays, names=list(b.schema.names) + list(arrow.names)
                )
        del fn
        tidy()

    return df.mapInArrow(run, out)


def long_id(df: DataFrame, name: str) -> Column:
    """The id column as a long; an error that says so where it isn't of an integer type."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"ids are of an integer type, and {name} is {kind.simpleString()}: number the rows first")
    return F.col(f"`{name}`").cast("long")


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of an id written as decimal text, as an unsigned long."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary"))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on an array."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


PIECE = 1 << 18  # bytes of a text that are hashed together
_BASE = np.uint64(0xD1342543DE82EF95 | 3)  # odd, and twice odd less one: its powers lie far apart
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """Powers of the base and of its inverse, codes of the 256 bytes (as they are, and with A-Z as a-z), and which are white space."""
    if not _tables:
        with np.errstate(over="ignore"):
            step = lambda x: np.concatenate([[np.uint64(1)], np.cumprod(np.full(PIECE, x, dtype=np.uint64))])
            inverse = pow(int(_BASE), -1, 1 << 64)
            plain = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            small = plain.copy()
            small[65:91] = plain[97:123]
            space = np.zeros(256, dtype=bool)
            space[[9, 10, 11, 12, 13, 32]] = True
            _tables.update(power=step(_BASE), inverse=step(np.uint64(inverse)), plain=plain, small=small, space=space)
    return _tables[name]


def cut_text(text: bytes):
    """Stretches of a text of a PIECE or less that end behind a word; a longer word comes alone."""
    at, spaces = 0, [bytes([b]) for b in (9, 10, 11, 12, 13, 32)]
    while len(text) - at > PIECE:
        # a stretch begins with the white space that the one before ended at
        cut = max(text.rfind(x, at + 1, at + PIECE) for x in spaces)
        if cut < 0:
            cut = min((k for x in spaces if (k := text.find(x, at + 1)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def _hash_piece(buf: np.ndarray, code: np.ndarray, edge: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    word = np.concatenate([[False], ~_table("space")[buf], [False]])
    turn = np.flatnonzero(word[1:] != word[:-1])
    start, end = turn[0::2], turn[1::2]
    bare = np.ones(len(start), dtype=bool)
    if edge is not None and len(start):
        # the nearest byte from the start on, and from the end back, that isn't an edge one
        inner = np.flatnonzero(~edge[buf] & word[1:-1])
        first, last = np.searchsorted(inner, start), np.searchsorted(inner, end) - 1
        bare = first <= last
        start = np.where(bare, inner[np.minimum(first, max(len(inner) - 1, 0))] if len(inner) else start, start)
        end = np.where(bare, (inner[np.maximum(last, 0)] if len(inner) else end) + 1, end)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(code[buf] * _table("power")[: len(buf)], dtype=np.uint64)])
        h = (total[end] - total[start]) * _table("inverse")[start]
        return mix64(h + (end - start).astype(np.uint64)), bare


def word_hashes(text: bytes | None, lower: bool = True, edge: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a text (a run of bytes that aren't ASCII white space), A-Z lowered or not, and whether it is ``bare``.

    Bytes of ``edge`` at a word's ends don't count; a word of nothing else isn't bare, and is hashed whole. Hashes are polynomials over the bytes,
    taken for all words at once from running sums; a text is worked through in pieces, a very long word in parts.
    """
    code = _table("small" if lower else "plain")
    trim = None
    if edge:
        trim = np.zeros(256, dtype=bool)
        trim[list(edge)] = True
    hashes, bares = [], []
    for piece in cut_text(text or b""):
        if len(piece) <= PIECE:
            h, bare = _hash_piece(np.frombuffer(piece, dtype=np.uint8), code, trim)
        else:
            word = piece.strip(b"\t\n\x0b\x0c\r ")
            inner = word.strip(edge) if edge else word
            bare, word = np.array([bool(inner)]), inner or word
            total = 0
            for k in range(0, len(word), PIECE):
                part = np.frombuffer(word[k : k + PIECE], dtype=np.uint8)
                with np.errstate(over="ignore"):
                    own = int((code[part] * _table("power")[: len(part)]).sum(dtype=np.uint64))
                total += own * pow(int(_BASE), k, 1 << 64)
            h = mix64(np.array([(total + len(word)) & ((1 << 64) - 1)], dtype=np.uint64))
        hashes.append(h)
        bares.append(bare)
    return (hashes[0], bares[0]) if len(hashes) == 1 else (np.concatenate(hashes), np.concatenate(bares))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` adjacent word hashes, in order; the whole sequence as one when it is shorter."""
    n = len(h)
    if n == 0:
        return h
    width = min(k, n)
    acc = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return acc
