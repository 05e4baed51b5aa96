"""Operator 11: fill-in-the-middle transformation by big-integer bit-parallelism.

A text's bytes are translated to a class mask, one bit a byte in one Python integer; shifted boolean operations on masks leave the bit of each unit's
first byte, ``bit_count`` says how many units there are, and a cut behind the k-th unit is found by halving the integer again and again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, long_id, read_table

MARKS = ("<P>", "<S>", "<M>")


def _class(*members: range | bytes) -> bytes:
    """A table for bytes.translate: the digit 1 for the members, 0 for other bytes."""
    own = {b for m in members for b in m}
    return bytes(49 if b in own else 48 for b in range(256))


_CONTINUES, _SPACE, _NEWLINE = _class(range(0x80, 0xC0)), _class(b"\t\n\v\f\r "), _class(b"\n")
UNITS = ("characters", "words", "lines")


def _mask(text: bytes, members: bytes) -> int:
    """Bit k is set where byte k of the text is a member of the class."""
    return int(text.translate(members)[::-1], 2)


def unit_starts(text: bytes, units: str = "characters") -> int:
    """Bit k is set where a unit begins at byte k. The first byte of a text always begins one.

    Characters begin at bytes that continue no code point, words behind white space (which belongs to the word before), lines behind a line feed.
    """
    if not text:
        return 0
    everywhere = (1 << len(text)) - 1
    if units == "characters":
        starts = everywhere & ~_mask(text, _CONTINUES)
    elif units == "words":
        space = _mask(text, _SPACE)
        starts = (space << 1) & ~space & everywhere
    elif units == "lines":
        starts = (_mask(text, _NEWLINE) << 1) & everywhere
    else:
        raise ValueError(f"units are one of {', '.join(UNITS)}")
    return starts | 1


def select(mask: int, rank: int) -> int:
    """The place of the set bit of this rank, from 0. Each step halves the integer, so all of them cost twice the first."""
    at, width = 0, mask.bit_length()
    while width > 1:
        half = width // 2
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, rank, at, width = mask >> half, rank - below, at + half, width - half
    return at


def cut_middle(text: bytes, one: int, other: int, units: str = "characters") -> tuple[int, int, int, int, int]:
    """Number of units n, units before the smaller and the larger of the two draws modulo n + 1, and the bytes there."""
    starts = unit_starts(text, units)
    n = starts.bit_count()
    a, b = sorted((one % (n + 1), other % (n + 1)))
    place = lambda k: len(text) if k == n else select(starts, k)
    return n, a, b, place(a), place(b)


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", units: str = "characters", seed: int = 1,
    rate: int = 90, spm_rate: int = 20, marks: tuple[str, str, str] = MARKS, prefix: str = "",
) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_units``, ``middle_units`` (null if plain) and ``output``.

    ``rate`` percent of the documents are changed, of which ``spm_rate`` percent put the suffix first; where the cuts lie, and both draws, depend on the
    seed and the id alone, which is of an integer type. A null text is an empty one; empty texts, and those that hold a mark, stay plain. A null id draws as if it were empty, and
    repeated rows draw alike. A bad byte in a text begins a character unless it is a continuation byte. A very long text costs an integer of an
    eighth of its size. Columns named like an added one are replaced, others pass through; an empty table gives an empty one.
    """
    if len(set(marks)) < 3 or any(m == "" or any(m[:k] == o[-k:] for o in marks for k in range(1, min(len(m), len(o)))) for m in marks):
        raise ValueError("marks are three different texts, none of which ends as one begins")
    if units not in UNITS:
        raise ValueError(f"units are one of {', '.join(UNITS)}")
    names = [prefix + c for c in ("n", "form", "prefix_units", "middle_units", "output")]
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    p, s, m = (x.encode() for x in marks)
    both = "__fim_both"

    def make():
        def run(keyed):
            out = [[] for _ in names]
            for pair in keyed:
                drawn, _, text = (pair or b"").partition(b"\0")
                h = hashlib.sha256(b"%d:" % seed + drawn).hexdigest()
                one, other, changes, first = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
                n, a, b, i, j = cut_middle(text, one, other, units)
                if not text or p in text or s in text or m in text or changes % 100 >= rate:
                    row = (n, "plain", None, None, text)
                elif first % 100 < spm_rate:
                    row = (n, "spm", a, b - a, b"".join((s, text[j:], p, text[:i], m, text[i:j])))
                else:
                    row = (n, "psm", a, b - a, b"".join((p, text[:i], s, text[j:], m, text[i:j])))
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return run

    # the id's digits travel in front of the text's bytes, so that one column carries both
    drawn = F.coalesce(long_id(docs, id_col).cast("string"), F.lit("")).cast("binary")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    added = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds)])
    return annotate(docs.withColumn(both, F.concat(drawn, F.unhex(F.lit("00")), text)), both, make, added).drop(both)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from the output and its form alone; each mark stands once in a changed one."""
    p, s, m = (F.lit(x) for x in marks)
    between = lambda a, b: F.split_part(F.split_part(output, a, F.lit(2)), b, F.lit(1))
    middle = F.split_part(output, m, F.lit(2))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select(long_id(docs, "doc_id").alias("doc_id"), "text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
