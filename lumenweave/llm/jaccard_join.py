"""Operator 3: exact n-gram Jaccard join and its components, by token-combination prefixes.

A document is its set of distinct word n-grams (tokens). Two sets that reach the threshold share at
least k tokens among the first ``n - ceil(t n) + k`` of any common order. The order used here is by
class, then hash: tokens of one document, tokens of few (rare), tokens of many (frequent). So

* a pair that shares a rare token of its extended prefixes is found by indexing single tokens,
* any other pair shares k frequent ones. These have one of C colours, by hash; with k above C two of the
  shared ones have one colour, so indexing the 2-combinations of one colour finds the pair. C belongs to a
  size class (sizes from a power of two to the next): it grows with the sizes, so that a set has a bounded
  number of combinations for each of its tokens, and is always less than what two sets of the class must
  share. Sets at the border of a class are indexed in the classes below too that they may link with. Where sets are so small
  that one shared token may be all they must share, C is 0 and single frequent tokens are indexed,

and every candidate is verified. Classes come from the document frequency of every token, counted over all
documents: each chunk of documents sends its distinct tokens to their buckets, which answer with the class of
those in two or more documents, and chunks and answers meet again by the chunk's number. No table of tokens is
broadcast or brought to the driver. A document goes on with these tokens alone: one without partners is in no
intersection, and how many a document has of them follows from the set's size.

Groups of similar texts are never expanded. Each posting list first verifies its members against one
pivot; only lists whose members still lie in different components are compared among themselves, in
blocks and only across components, on parity bitmaps: the bits in which two of them differ are at most
the shared tokens in which the sets differ, so what they rule out is ruled out for certain, and only the pairs
that remain become rows to verify. Equal sets are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, long_id, mix64, read_table, ship_package, tidy, window_hashes, word_hashes
from .components import components

LOW = np.uint64((1 << 48) - 1)
CHUNK = 500_000  # tokens of the documents that send and are answered together
BUCKET_BYTES = 6_000_000  # of text, whose tokens one bucket counts
BLOCK = 1024  # members of a posting list that one comparison holds twice, at most
CLASSES = 40  # of sizes: from 2 ** c to 2 ** (c + 1)
PER_TOKEN = 2.5  # combinations of a set for each of its tokens, at most about


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text, A-Z lowered; empty without words."""
    return np.unique(window_hashes(word_hashes(text)[0], width))


def _least(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with every set it links with, at least."""
    return -(-percent * n // 100)


def colours(size_class: int, percent: int) -> int:
    """C of a size class; 0: single frequent tokens are indexed."""
    low = 1 << size_class
    apart = 1 - percent / 100
    return max(1, min(int(np.ceil(apart * apart * low / (2 * PER_TOKEN))), _least(low, percent) - 1)) if _least(low, percent) > 1 else 0


def size_classes(n: int, percent: int) -> list[int]:
    """The class of a size, and those below whose sets may link with it: a pair meets in the class of the smaller set."""
    return list(range(_least(n, percent).bit_length() - 1, n.bit_length()))


def _bucket(tokens: np.ndarray, n: int) -> np.ndarray:
    return ((tokens >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)


def pack_places(places: list[np.ndarray]) -> list[bytes]:
    """Ascending numbers as gaps of 16 bits, one array each; 65535 means that as much and what follows."""
    gaps = np.concatenate([np.diff(p, prepend=0) for p in places]).astype(np.int64)
    whole, rest = np.divmod(gaps, 65535)
    at = np.cumsum(whole + 1) - 1
    out = np.full(int(at[-1]) + 1, 65535, dtype="<u2")
    out[at] = rest
    ends = at[np.cumsum([len(p) for p in places]) - 1] + 1
    return [x.tobytes() for x in np.split(out, ends[:-1])]


def unpack_places(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all arrays, and where each array ends among them."""
    gaps = np.frombuffer(b"".join(blobs), dtype="<u2").astype(np.int64)
    last = np.flatnonzero(gaps != 65535)
    total = np.cumsum(gaps)
    blob_end = np.cumsum([len(x) // 2 for x in blobs])
    ends = np.searchsorted(last, blob_end)
    before = np.concatenate([[0], total[blob_end[:-1] - 1]])
    return total[last] - np.repeat(before, np.diff(ends, prepend=0)), ends


SENT = "key long, chunk long, id long, n_shingles long, s1 long, s2 long, places binary, start long, four binary, two binary, times binary"


def sent_tokens(docs: DataFrame, n: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """Two kinds of rows. ``key`` below 0: a document of a chunk, with its set's size, signature (two sums over its tokens) and its
    tokens as places in the chunk's list of distinct tokens. Otherwise: those of a chunk's tokens that fall into bucket ``key``, from
    place ``start`` on, as 48 bits each, with their counts in the chunk (255 at most, which is above any ``rare``)."""

    def run(batches):
        from pyspark import TaskContext

        chunk, held, count = TaskContext.get().partitionId() << 32, [], 0
        kinds = [pa.binary() if f.endswith("binary") else pa.int64() for f in SENT.split(", ")]
        names = [f.split()[0] for f in SENT.split(", ")]

        def rows(n_rows, **cols):
            full = [pa.array(cols[c], k) if c in cols else pa.nulls(n_rows, k) for c, k in zip(names, kinds)]
            return pa.RecordBatch.from_arrays(full, names=names)

        def flush():
            ids, sets = zip(*held)
            u, back, c = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            size = np.array([len(x) for x in sets])
            ends = np.cumsum(size)
            some = size > 0
            mixed, salt = mix64(u)[back], np.repeat(size.astype(np.uint64), size)
            both = [np.zeros(len(sets), dtype=np.uint64) for _ in range(2)]
            if len(u):
                begin = (ends - size)[some]
                both[0][some] = np.add.reduceat(mixed, begin)
                both[1][some] = np.bitwise_xor.reduceat(mix64(mixed + salt), begin)
            packed = iter(pack_places([x for x in np.split(back, ends[:-1]) if len(x)]) if len(u) else [])
            places = [next(packed) if x else None for x in some.tolist()]
            s1, s2 = (x.view(np.int64) for x in both)
            yield rows(len(ids), key=np.full(len(ids), -1 - chunk), chunk=np.full(len(ids), chunk), id=ids, n_shingles=size, s1=s1, s2=s2, places=places)
            # tokens are sorted, and so are their buckets: only those that have some are gone through
            bucket = _bucket(u, n).astype(np.int64)
            start = np.flatnonzero(np.diff(bucket, prepend=-1))
            end = np.append(start[1:], len(u))
            low = u & LOW
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())]
            four, two, times = low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16), np.minimum(c, 255).astype(np.uint8)
            yield rows(len(start), key=bucket[start], chunk=np.full(len(start), chunk), start=start, four=cut(four), two=cut(two), times=cut(times))

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                s = shingle_set(t.as_py(), width)
                held.append((doc, s))
                count += len(s)
                if count >= CHUNK or len(held) >= CHUNK:
                    yield from flush()
                    chunk, held, count = chunk + 1, [], 0
        if held:
            yield from flush()
        del held
        tidy()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, SENT)


def _identity(bucket: int, low: np.ndarray) -> np.ndarray:
    """A token's number from its bucket and 48 bits, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix64(low + np.uint64(bucket + 1) * np.uint64(0x9E3779B97F4A7C15))


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


ANSWERED = "chunk long, id long, n_shingles long, s1 long, s2 long, places binary, start long, shared binary, frequent binary, tokens binary"


def answered_tokens(sent: DataFrame, rare: int) -> DataFrame:
    """Documents as they are; and per chunk and bucket, which of the chunk's tokens there, in order, are in two or more documents
    (``shared``), their numbers (``tokens``), and which of these are in more than ``rare`` (``frequent``)."""
    names = [f.split()[0] for f in ANSWERED.split(", ")]
    kinds = [pa.binary() if f.endswith("binary") else pa.int64() for f in ANSWERED.split(", ")]

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("key")[0].as_py()
        if bucket < 0:
            return pa.table({c: table.column(c) if c in table.column_names else pa.nulls(len(table), k) for c, k in zip(names, kinds)})
        times = _joined(table, "times", np.uint8)
        low = _joined(table, "four", np.uint32).astype(np.uint64) | _joined(table, "two", np.uint16).astype(np.uint64) << np.uint64(32)
        _, back = np.unique(low, return_inverse=True)
        total = np.bincount(back, weights=times)[back]
        ends = np.cumsum([len(x) for x in table.column("times").to_pylist()])
        shared, total, low = (np.split(x, ends[:-1]) for x in (total > 1, total, low))
        some = [k for k, x in enumerate(shared) if x.any()]
        made = {
            "shared": [np.packbits(shared[k]).tobytes() for k in some],
            "frequent": [np.packbits(total[k][shared[k]] > rare).tobytes() for k in some],
            "tokens": [_identity(bucket, low[k][shared[k]]).tobytes() for k in some],
        }
        kept = {c: table.column(c).take(pa.array(some, pa.int64())) for c in ("chunk", "start")}
        del low, back, total, times, shared
        tidy()
        return pa.table({c: kept[c] if c in kept else pa.array(made[c], k) if c in made else pa.nulls(len(some), k) for c, k in zip(names, kinds)})

    return sent.groupBy("key").applyInArrow(answer, ANSWERED)


def parity_bits(tokens: np.ndarray, n: int) -> bytes:
    """A bitmap of at least 4 bits for each of a set's ``n`` tokens (512 to 32768 bits), each the parity of those of ``tokens`` that hash to it.

    Two sets differ in as many tokens as their bitmaps differ in bits, or more. A longer bitmap folds to
    half its length by exclusive or.
    """
    size = 512
    while size < 4 * n and size < 32768:
        size *= 2
    at = (tokens >> np.uint64(40)).astype(np.int64) & (size - 1)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def close_pairs(ids, comps, sizes, held, chunks, bitmaps, percent: int) -> tuple[list[int], list[int]]:
    """Pairs of different components (and, where the block has two chunks, of different ones) that bitmaps of the ``held`` tokens don't rule out."""
    order = np.argsort(sizes, kind="stable")
    ids, comps, sizes, held, chunks = (np.asarray(x)[order] for x in (ids, comps, sizes, held, chunks))
    bitmaps = [np.frombuffer(bitmaps[k], dtype=np.uint64) for k in order]
    two = len(np.unique(chunks)) > 1
    ends = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    words = np.array([len(x) for x in bitmaps])  # grows with the size, by factors of two
    a, b = [], []
    for length in np.unique(words).tolist():
        first = int(np.searchsorted(words, length))
        last = int(np.searchsorted(words, length, side="right"))
        until = int(ends[first:last].max())
        rows = np.empty((until - first, length), dtype=np.uint64)
        for k in range(first, until):
            x = bitmaps[k]
            while len(x) > length:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            rows[k - first] = x
        for k in range(first, last):
            other = slice(k + 1, int(ends[k]))
            may = comps[other] != comps[k]
            if two:
                may &= chunks[other] != chunks[k]
            if not may.any():
                continue
            apart = np.bitwise_count(rows[k + 1 - first : int(ends[k]) - first] ^ rows[k - first]).sum(axis=1)
            need = -(-percent * (sizes[other] + sizes[k]) // (100 + percent))
            for j in (np.flatnonzero(may & (apart <= held[other] + held[k] - 2 * need)) + k + 1).tolist():
                x, y = int(ids[k]), int(ids[j])
                a.append(max(x, y))
                b.append(min(x, y))
    return a, b


def block_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Close pairs (a, b) of posting lists: rows (k0, k1, k2, i, j, chunk, id, component, n, held, bits), a block (k0, k1, k2, i, j) at a time."""

    def run(batches):
        held, at = [], None

        def done():
            x = list(zip(*held))
            a, b = close_pairs(*x[1:5], x[0], x[5], percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != at:
                    if len(held) > 1:
                        yield done()
                    held, at = [], row[:5]
                held.append(row[5:])
        if len(held) > 1:
            yield done()

    key = ["k0", "k1", "k2", "i", "j"]
    dealt = lists.select(*key, "chunk", "id", "component", "n", "held", "bits").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a long, b long")


PREFIX = "id long, n_shingles long, s1 long, s2 long, classes array<int>, rare array<long>, frequent array<long>, tokens binary, bits binary"


def prefixes(answered: DataFrame, percent: int) -> DataFrame:
    """Per document: size and signature; and where its prefix holds shared tokens: its size classes, these tokens by class, and all shared tokens of the set."""

    def run(table: pa.Table) -> pa.Table:
        docs = table.filter(pa.compute.is_valid(table.column("n_shingles")))
        said = table.filter(pa.compute.is_valid(table.column("start")))
        some = [x for x in docs.column("places").to_pylist() if x is not None]
        places, ends = unpack_places(some) if some else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        size = int(places.max()) + 1 if len(places) else 0
        kind, token = np.zeros(size, dtype=np.int8), np.zeros(size, dtype=np.uint64)
        bits = lambda x, n: np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n)
        for start, shared, frequent, tokens in zip(*(said.column(c).to_pylist() for c in ("start", "shared", "frequent", "tokens"))):
            t = np.frombuffer(tokens, dtype=np.uint64)
            at = start + np.flatnonzero(bits(shared, 8 * len(shared)))
            kind[at], token[at] = 1 + bits(frequent, len(t)), t
        begin, own = iter([0, *ends[:-1].tolist()]), iter(ends.tolist())
        kinds, cols = kind[places], [[] for _ in range(5)]
        for n, p in zip(docs.column("n_shingles").to_pylist(), docs.column("places").to_pylist()):
            row = (None, [], [], None, None)
            if p is not None:
                lo, hi = next(begin), next(own)
                c = kinds[lo:hi]
                which = size_classes(n, percent)
                m = min(n, n - _least(n, percent) + colours(which[-1], percent) + 1)
                hit = np.flatnonzero(c)
                if n - len(hit) < m:  # of a common order the tokens without partners come first
                    s, c = token[places[lo:hi][hit]], c[hit]
                    order = np.lexsort((s, c))[: m - (n - len(hit))]
                    c, head = c[order], s[order]
                    row = (which, head[c == 1].view(np.int64), head[c == 2].view(np.int64), np.sort(s).tobytes(), parity_bits(s, n))
            for col, x in zip(cols, row):
                col.append(x)
        types = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        made = dict(zip(("classes", "rare", "frequent", "tokens", "bits"), (pa.array(c, x) for c, x in zip(cols, types))))
        del cols, kinds, kind, token, places, some
        tidy()
        return pa.table({**{c: docs.column(c) for c in ("id", "n_shingles", "s1", "s2")}, **made})

    return answered.groupBy("chunk").applyInArrow(run, PREFIX)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets reach the threshold: by their sizes and the tokens they share."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y, n, m in zip(b.column("ta"), b.column("tb"), b.column("na").to_pylist(), b.column("nb").to_pylist()):
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                both = np.concatenate([np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y)])
                both.sort(kind="stable")
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * inter >= percent * (n + m - inter))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}"), F.col("n_shingles").alias(f"n{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb", "na", "nb")
    return joined.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rare: int = 32) -> DataFrame:
    """Per row: the id, ``n_shingles`` and ``component_id``, the smallest id reachable by links, itself included.

    Two rows link when 100 * |A & B| >= percent * |A | B| over their distinct ``width``-word shingles; exact for every
    ``percent`` from 1 to 100. ``rare`` (254 at most): a token of more documents counts as frequent.

    Ids are of an integer type. Nulls: a null text has no shingles and links with nothing, like an empty one or one of white
    space; a null id comes back with a null component and links with nothing. Very long texts: taken whole, whatever their size. Ties: a pair
    exactly at the threshold links. Repeated rows: come back a row each; rows with one id are one document with the links of
    all of them. An empty table gives an empty result. Columns other than id and text are ignored, whatever their names.
    """
    if not 1 <= percent <= 100 or not 1 <= rare <= 254:
        raise ValueError("percent is from 1 to 100, rare from 1 to 254")
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(long_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("t"))
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(max(8, -(-size // BUCKET_BYTES)))
    answered = scratch.table(answered_tokens(sent_tokens(docs, n, "id", "t", width), rare), "answered")
    rows = scratch.table(prefixes(answered, percent), "prefixes")
    scratch.drop("answered")
    real = rows.filter("n_shingles > 0 AND id IS NOT NULL")
    key = ["n_shingles", "s1", "s2"]
    groups = scratch.table(real.groupBy(*key).agg(F.min("id").alias("rep")), "groups")
    # of each group of equal sets one row goes on, and only where it has tokens that others may share
    sets = scratch.table(
        real.filter("tokens IS NOT NULL").join(groups, key).filter("id = rep").select("id", "n_shingles", "classes", "rare", "frequent", "tokens", "bits"),
        "sets",
    )
    # an id with several texts joins their groups
    member = real.select("id", *key).join(groups, key).select("id", "rep")
    several = member.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("id")
    same_id = member.join(several, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    posts = sets.select("id", F.explode(F.concat("rare", "frequent")).alias("token"))
    pivots = posts.groupBy("token").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").select("token", "b")
    tried = scratch.table(posts.join(pivots, "token").filter("id <> b").select(F.col("id").alias("a"), "b").distinct(), "tried")
    links = scratch.table(verified(tried, sets, percent).union(same_id), "links-0")
    joined = components(links, scratch, "first")

    # posting lists that still hold several components
    posts = sets.select("id", "classes", F.explode("rare").alias("token"), F.lit(False).alias("often")).union(
        sets.select("id", "classes", F.explode("frequent"), F.lit(True))
    )
    placed = posts.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (
        placed.groupBy("token", "often")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
        .filter("lo <> hi AND n > 2")  # of two, the pivot's check has decided
        .select("token")
    )
    open_posts = scratch.table(placed.join(mixed, "token"), "open")
    long = lambda x: F.lit(x).cast("long")
    single = open_posts.filter("NOT often").select("id", "component", F.lit(-1).alias("k0"), F.col("token").alias("k1"), long(0).alias("k2"))
    often = open_posts.filter("often").select("id", "component", "token", F.explode("classes").alias("k0"))
    often = often.withColumn("c", F.element_at(F.array(*[F.lit(colours(k, percent)) for k in range(CLASSES)]), F.least(F.col("k0") + 1, F.lit(CLASSES))))
    alone = often.filter("c = 0").select("id", "component", "k0", F.col("token").alias("k1"), long(1).alias("k2"))
    coloured = often.filter("c > 0").groupBy("id", "component", "k0", F.pmod(F.shiftright("token", 7), "c")).agg(F.array_sort(F.collect_set("token")).alias("f"))
    twos = coloured.select("id", "component", "k0", "f", F.posexplode("f").alias("p", "k1")).select(
        "id", "component", "k0", "k1", F.explode(F.slice("f", F.col("p") + 2, F.size("f"))).alias("k2")
    )
    keys = single.union(alone).union(twos)
    ks = ["k0", "k1", "k2"]
    # of lists with the same members one is enough
    lists = (
        keys.groupBy(*ks)
        .agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2"),
        )
        .filter("lo <> hi")
        .groupBy("lo", "hi", "n", "x1", "x2")
        .agg(F.min(F.struct(*ks)).alias("k"))
        .select("k.k0", "k.k1", "k.k2", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks"))
    )
    blocks = (
        keys.join(lists, ks)
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*ks, F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "id", "component")
        .join(sets.select("id", F.col("n_shingles").alias("n"), (F.octet_length("tokens") / 8).cast("long").alias("held"), "bits"), "id")
    )
    across = block_pairs(blocks, percent).distinct().join(tried, ["a", "b"], "left_anti")
    more = scratch.table(verified(across, sets, percent), "links-1")
    if not more.isEmpty():
        joined = components(links.union(more), scratch, "second")
    scratch.drop("open", "sets", "tried")
    found = groups.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("c"))
    placed = rows.select("id", *key).join(found, key, "left")
    return placed.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return jaccard_components(docs, width=4, percent=85)


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near duplicates: the one of the smallest id.

    Ids are of an integer type. Rows without words or id link with nothing and stay. Of several rows with one id the one of the smallest
    text stays (a null is the largest; of equal rows one). Very long texts are compared whole, an empty table gives an empty
    one, and all columns pass through.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    found = scratch.table(jaccard_components(docs, id_col, text_col, width, percent).filter(f"`{id_col}` IS NOT NULL"), "components")
    gone = scratch.table(found.filter(F.col("component_id") != F.col(f"`{id_col}`")).select(id_col).distinct(), "gone")
    kept = docs.join(gone, id_col, "left_anti")
    several = scratch.table(found.groupBy(id_col).count().filter("count > 1").select(id_col), "several")
    if not several.isEmpty():
        first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(f"`{text_col}`").asc_nulls_last()))
        one = kept.join(several, id_col, "left_semi").withColumn("__lw_first", first).filter("__lw_first = 1").drop("__lw_first")
        kept = kept.join(several, id_col, "left_anti").unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
