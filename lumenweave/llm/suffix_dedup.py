"""Operator 13: removal of repeated spans by sorted suffixes.

Each window of ``span`` bytes has an anchor: the place in it whose next bytes (a gram) have the smallest hash, the first of several. Equal windows have equal grams at
equal distances, so only texts around equal grams need be compared. Grams that stand at one place only in the whole table are found by counting hashes; around every
other anchor, the suffix from it on and the bytes in front of it, read backwards, go to the gram's bucket. There both are put in order by a deep-shallow sort: multikey
quicksort on characters of eight bytes to a shallow depth, then a blind trie for each group that is still equal. The lengths of common prefixes of neighbours in both
orders say which windows are equal, byte for byte; all but the first of them are removed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE, Scratch, _table, long_id, mix64, read_table, ship_package, tidy

CHUNK = 16 << 20  # bytes of text whose anchors are kept together in a task
BUCKET_BYTES = 32 << 20  # of text, whose grams share a bucket
BUCKET_ROWS = 50_000  # contexts that are sorted together, but for those of one gram
HOT = 20_000  # places of a gram beyond which its windows are dealt out one by one
MOST_HOT = 4 << 20  # such grams at most: beyond that HOT grows with the table
SHALLOW = 40  # bytes that multikey quicksort compares; a multiple of 8
_NULL = -(1 << 63)  # stands for a null id, which comes first
_ENTRY = np.dtype([("hash", "<u8"), ("rid", "<i8"), ("at", "<i8"), ("n", "<u4")])


# --- anchors


def gram_size(span: int) -> int:
    return max(1, span * 8 // 25)


def anchors(buf: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in a buffer of texts that end at ``ends``: place, first and last start of its windows, the gram's hash."""
    k, n = gram_size(span), len(buf)
    if n < span:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_table("plain")[buf] * _table("power")[:n], dtype=np.uint64)])
        grams = mix64((total[k:] - total[:-k]) * _table("inverse")[: n - k + 1])
    low = np.uint64(PIECE * 2 - 1)  # the place takes the low bits: of equal hashes the first is smallest
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, want = 1, span - k + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    ends_at = np.repeat(ends, np.diff(ends, prepend=0))[: n - span + 1]
    start = np.flatnonzero(ends_at - np.arange(len(ends_at)) >= span)
    place = (least[start] & low).astype(np.int64)
    turn = np.flatnonzero(place[1:] != place[:-1]) + 1 if len(place) else np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], turn])[: len(place)].astype(np.int64)
    last = np.concatenate([turn - 1, [len(place) - 1]])[: len(place)].astype(np.int64)
    return place[first], start[first], start[last], grams[place[first]]


def _stretches(texts, span: int):
    """(texts' numbers, offsets of their first byte here, bytes, ends): short texts together, a long one in stretches that share span - 1 bytes."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - span + 1), PIECE - span + 1):
            part = text[at : at + PIECE] if len(text) > PIECE else text
            if size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def pack(place: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A place in a text and the largest and smallest distance of its windows' starts in front of it, as one long."""
    return place << 24 | most << 12 | least


def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 24, x >> 12 & 4095, x & 4095


def text_anchors(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' anchors: the text's number, the packed place, the gram's hash."""
    out = []
    for held in _stretches(texts, span):
        buf = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
        ends = np.cumsum([len(p) for _, _, p in held])
        place, first, last, h = anchors(buf, ends, span)
        own = np.searchsorted(ends, first, side="right")
        shift = np.array([at - end + len(p) for (_, at, p), end in zip(held, ends)], dtype=np.int64)[own]
        out.append((np.array([i for i, _, _ in held], dtype=np.int64)[own], pack(place + shift, place - first, place - last), h))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


# --- deep-shallow sort


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit words."""
    return sum((x >> np.uint64(64 - 8 * b) == 0).astype(np.int64) for b in range(1, 8)) if len(x) else np.zeros(0, dtype=np.int64)


def common_prefix(s: bytes, t: bytes) -> int:
    m = min(len(s), len(t))
    x = int.from_bytes(s[:m]) ^ int.from_bytes(t[:m])
    return m - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], ids: list[int]) -> tuple[list[int], list[int]]:
    """``ids`` in order of their strings, and how many bytes each shares with the one before (0 for the first).

    An inner node is (depth, children by the byte there, -1 for a string that ends); a leaf is a list of ids of equal strings. A string goes down by the bytes at the
    nodes' depths alone, is compared once with the leaf it comes to, and is hung in at the depth where the two differ.
    """
    root = [ids[0]]
    for i in ids[1:]:
        s, node = strings[i], root
        while type(node) is tuple:
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1) or next(iter(kids.values()))
        t = strings[node[0]]
        if s == t:
            node.append(i)
            continue
        shared = common_prefix(s, t)
        above, node = None, root
        while type(node) is tuple and node[0] < shared:
            above, edge = node[1], s[node[0]]
            node = above[edge]
        mine = s[shared] if shared < len(s) else -1
        if type(node) is tuple and node[0] == shared:
            node[1][mine] = [i]
            continue
        fork = (shared, {t[shared] if shared < len(t) else -1: node, mine: [i]})
        if above is None:
            root = fork
        else:
            above[edge] = fork
    out, lcps, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if type(node) is tuple:
            depth, kids = node
            edges = sorted(kids)
            stack += [(kids[e], depth) for e in edges[:0:-1]] + [(kids[edges[0]], shared)]
        else:
            out += node
            lcps += [shared] + [len(strings[node[0]])] * (len(node) - 1)
    return out, lcps


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The strings' order, and the bytes that each shares with the one before it in that order (0 for the first)."""
    n = len(strings)
    order, lcp, opens = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    if not n:
        return order, lcp
    length = np.fromiter(map(len, strings), dtype=np.int64, count=n)
    words = np.frombuffer(b"".join([s[:shallow].ljust(shallow, b"\0") for s in strings]), dtype=">u8").astype(np.uint64).reshape(n, -1)
    opens[0] = True
    for w in range(words.shape[1]):
        segment = np.cumsum(opens) - 1
        at = np.flatnonzero(np.bincount(segment)[segment] > 1)  # places in segments that are not settled
        if not len(at):
            break
        own = segment[at]
        order[at] = order[at][np.lexsort((words[order[at], w], own))]
        key = words[order[at], w]
        parts = (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        begins = at[1:][parts]
        lcp[begins] = 8 * w + _equal_bytes(key[1:][parts] ^ key[:-1][parts])
        opens[begins] = True
    begins = np.flatnonzero(opens)
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), n]):
        if b - a > 1:
            order[a:b], (_, *lcp[a + 1 : b]) = blind_trie(strings, order[a:b].tolist())
    lcp[1:] = np.minimum(lcp[1:], np.minimum(length[order[1:]], length[order[:-1]]))
    return order, lcp


def later_windows(contexts: list[bytes], most: np.ndarray, least: np.ndarray, rank: np.ndarray, span: int) -> np.ndarray:
    """A row a context, a column a distance of a window's start in front of the anchor: whether an equal window has a smaller rank.

    A context is the bytes of an anchor's windows, ``most`` bytes of which come before it.
    """
    n, wide = len(contexts), span - gram_size(span) + 1
    right_order, right = deep_shallow([c[m:] for c, m in zip(contexts, most.tolist())])
    left_order, left = deep_shallow([c[:m][::-1] for c, m in zip(contexts, most.tolist())])
    by_rank = np.argsort(rank, kind="stable")
    again = np.zeros((n, wide), dtype=bool)
    of = np.empty((2, n), dtype=np.int64)
    for o in range(wide):
        own = by_rank[(least[by_rank] <= o) & (o <= most[by_rank])]
        if len(own) < 2:
            continue
        of[0, right_order] = np.cumsum(right < span - o)
        of[1, left_order] = np.cumsum(left < o)
        key = of[0, own] * (n + 1) + of[1, own]
        by = np.argsort(key, kind="stable")
        sorted_key, sorted_own = key[by], own[by]
        opens = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        earliest = rank[sorted_own[opens]][np.cumsum(opens) - 1]
        again[sorted_own, o] = rank[sorted_own] > earliest
    return again


# --- the job


def _lists(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each row of ``keys`` that differs from the one before (they are in order), where it begins, and its rows of ``values`` as a list."""
    opens = np.flatnonzero(np.concatenate([[True], np.any(keys[1:] != keys[:-1], axis=1)])) if len(keys) else np.zeros(0, dtype=np.int64)
    offsets = np.concatenate([opens, [len(keys)]]) * (values.size // max(1, len(values)))
    return opens, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.reshape(-1), pa.int64()))


def _batch(schema: str, **columns) -> pa.RecordBatch:
    """A batch of the schema; columns that aren't given are null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(T._parse_datatype_string(schema)) if isinstance(schema, str) else schema
    rows = len(next(iter(columns.values())))
    cols = [columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in fields]
    return pa.RecordBatch.from_arrays(cols, schema=fields)


def _chunks(batches):
    """(rows of columns) of about a chunk of text each; the text is the second column."""
    held, size = [], 0
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if held and size + len(row[1]) > CHUNK:
                yield list(zip(*held))
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield list(zip(*held))


def _repeated_grams(keyed: DataFrame, span: int, buckets: int, hot: int) -> DataFrame:
    """(rid, hits): anchors whose gram stands elsewhere too, as its hash and the packed place in turn; and rows without rid of hashes beyond ``hot``."""
    # the schemas are made here: tasks have no session to parse them with
    sent, back = _arrow("bucket int, entries binary, rid long, hits array<long>"), _arrow("rid long, hits array<long>")

    def find(batches):
        for rids, texts in _chunks(batches):
            doc, at, h = text_anchors(list(texts), span)
            by = np.argsort(h, kind="stable")
            doc, at, h = doc[by], at[by], h[by]
            opens = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
            n = np.diff(opens, append=len(h))
            rid = np.array(rids, dtype=np.int64)
            # a gram's first place here goes to its bucket; where it has others here, all of its places are hits at once and only the count goes
            entries = np.empty(len(opens), dtype=_ENTRY)
            entries["hash"], entries["rid"], entries["at"], entries["n"] = h[opens], rid[doc[opens]], at[opens], np.minimum(n, (1 << 32) - 1)
            bucket = (entries["hash"] % np.uint64(buckets)).astype(np.int64)
            entries = entries[np.argsort(bucket, kind="stable")]
            cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            rows = [(k, entries[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            if rows:
                yield _batch(sent, bucket=[k for k, _ in rows], entries=[x for _, x in rows])
            many = np.repeat(n > 1, n)
            doc, at, h = doc[many], at[many], h[many]
            by = np.argsort(doc, kind="stable")
            own, hits = _lists(doc[by, None], np.stack([h[by].view(np.int64), at[by]], axis=1))
            if len(own):
                whose = rid[doc[by][own]]
                yield _batch(sent, bucket=(whose % buckets).astype(np.int32), rid=whose, hits=hits)
        tidy()

    def answer(table: pa.Table) -> pa.Table:
        known = table.filter(table.column("rid").is_valid()).select(["rid", "hits"]).combine_chunks()
        e = np.frombuffer(b"".join(x for x in table.column("entries").to_pylist() if x is not None), dtype=_ENTRY)
        e = e[np.argsort(e["hash"], kind="stable")]
        opens = np.flatnonzero(np.concatenate([[True], e["hash"][1:] != e["hash"][:-1]])[: len(e)])
        places = np.add.reduceat(e["n"].astype(np.int64), opens) if len(e) else np.zeros(0, dtype=np.int64)
        size = np.diff(opens, append=len(e))
        mine = e[np.repeat(places > 1, size) & (e["n"] == 1)]
        mine = mine[np.argsort(mine["rid"], kind="stable")]
        own, hits = _lists(mine["rid"][:, None], np.stack([mine["hash"].view(np.int64), mine["at"]], axis=1))
        parts = [known.cast(back), pa.Table.from_batches([_batch(back, rid=mine["rid"][own], hits=hits)])]
        heavy = e["hash"][opens[places > hot]].view(np.int64)
        if len(heavy):
            parts.append(pa.Table.from_batches([_batch(back, hits=pa.array([heavy.tolist()], pa.list_(pa.int64())))]))
        return pa.concat_tables(parts)

    found = keyed.select("rid", "text").mapInArrow(find, "bucket int, entries binary, rid long, hits array<long>")
    return found.groupBy("bucket").applyInArrow(answer, "rid long, hits array<long>")


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


_CONTEXT = "key long, context binary, most int, least int, doc long, rid long, place long, spans array<long>"


def _contexts(found: DataFrame, span: int, hot: np.ndarray) -> DataFrame:
    """The bytes around each hit, once for each chunk of documents, with the first place of them there; and spans of the other places, which are repeats."""
    sent, made = found.sparkSession.sparkContext.broadcast(np.sort(hot)), _arrow(_CONTEXT)

    def run(batches):
        hot = sent.value
        for docs, texts, rids, hits in _chunks(batches):
            rows, contexts, keys, number = [], [], [], {}
            for i, (text, hit) in enumerate(zip(texts, hits)):
                pairs = np.array(hit, dtype=np.int64).reshape(-1, 2)
                place, most, least = unpack(pairs[:, 1])
                single = np.isin(pairs[:, 0].view(np.uint64), hot) if len(hot) else np.zeros(len(pairs), dtype=bool)
                for h, p, m, l, alone in zip(pairs[:, 0].tolist(), place.tolist(), most.tolist(), least.tolist(), single.tolist()):
                    for hi, lo in ((o, o) for o in range(l, m + 1)) if alone else ((m, l),):
                        part = text[p - hi : p - lo + span]
                        if p < hi or len(part) != hi - lo + span:
                            continue  # of another text with the same rid
                        k = number.setdefault((part, hi), len(number))
                        if k == len(contexts):
                            contexts.append(part)
                            keys.append(zlib.crc32(part) if alone else h)
                        rows.append((k, i, p, hi, lo))
            if not rows:
                continue
            k, i, place, most, least = np.array(rows, dtype=np.int64).T
            del rows, number
            doc, rid = np.array(docs, dtype=np.int64)[i], np.array(rids, dtype=np.int64)[i]
            by = np.lexsort((place, rid, doc, k))
            k, doc, rid, place, most, least = (x[by] for x in (k, doc, rid, place, most, least))
            opens = np.concatenate([[True], k[1:] != k[:-1]])
            first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
            later = (doc != doc[first]) | (rid != rid[first]) | (place != place[first])
            f = np.flatnonzero(opens)
            yield _batch(made, key=np.array(keys, dtype=np.int64)[k[f]], context=[contexts[x] for x in k[f].tolist()], most=most[f], least=least[f], doc=doc[f], rid=rid[f], place=place[f])
            yield _marks(made, doc[later], rid[later], (place - most)[later], (place - least + span)[later])
        tidy()

    return found.select("doc", "text", "rid", "hits").mapInArrow(run, _CONTEXT)


def _marks(schema: pa.Schema, doc: np.ndarray, rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """A row a document of the spans to remove from it."""
    by = np.lexsort((start, rid, doc))
    own, spans = _lists(np.stack([doc[by], rid[by]], axis=1), np.stack([start[by], end[by]], axis=1))
    return _batch(schema, doc=doc[by][own], rid=rid[by][own], spans=spans)


def _compared(contexts: DataFrame, span: int, buckets: int) -> DataFrame:
    """(doc, rid, spans) of windows that equal an earlier one, by the order of the suffixes in each bucket."""
    made = _arrow("doc long, rid long, spans array<long>")

    def compare(table: pa.Table) -> pa.Table:
        most, least, doc, rid, place = (table.column(c).to_numpy().astype(np.int64) for c in ("most", "least", "doc", "rid", "place"))
        order = np.lexsort((place, rid, doc))
        changes = [np.concatenate([[False], x[order][1:] != x[order][:-1]]) for x in (doc, rid, place)]
        rank = np.empty(len(doc), dtype=np.int64)
        rank[order] = np.cumsum(changes[0] | changes[1] | changes[2])
        again = later_windows(table.column("context").to_pylist(), most, least, rank, span)
        edge = np.zeros((len(again), 1), dtype=bool)
        before = np.concatenate([edge, again[:, :-1]], axis=1)
        after = np.concatenate([again[:, 1:], edge], axis=1)
        row, low = np.nonzero(again & ~before)  # runs of distances, in the same order of rows
        _, high = np.nonzero(again & ~after)
        return pa.Table.from_batches([_marks(made, doc[row], rid[row], place[row] - high, place[row] - low + span)])

    rows = contexts.filter("key is not null").select(F.pmod("key", F.lit(buckets)).alias("bucket"), "context", "most", "least", "doc", "rid", "place")
    return rows.groupBy("bucket").applyInArrow(compare, "doc long, rid long, spans array<long>")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 100) -> DataFrame:
    """``docs`` with ``removed``, the spans (start, end) of bytes covered by a string of ``span`` bytes that starts earlier too, and ``kept``, the other bytes.

    Earlier is a smaller id, or an earlier start in the same document; strings overlap, stay in one document, and are judged on the texts as they come. ``kept`` is
    binary, because a cut may fall inside a character. A null id comes before all others and a null text is empty. Rows that are equal in id and text are one document:
    each gets its result. Other rows of one id are ordered by a hash of the text. Texts of any length are read whole, in stretches; shorter
    ones than ``span`` are kept. Columns named like an added one are replaced, others pass through; an empty table gives an empty one.
    """
    if not 1 <= span <= 4000:
        raise ValueError("a span is 1 to 4000 bytes")
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "suffix-dedup")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rid = F.xxhash64(F.col(f"`{id_col}`"), text)
    keyed = docs.select(F.coalesce(long_id(docs, id_col), F.lit(_NULL)).alias("doc"), text.alias("text"), rid.alias("rid"))

    size = keyed.agg(F.sum(F.octet_length("text")).alias("s")).first().s or 0
    hot = max(HOT, size // MOST_HOT)  # a place takes a byte or more, so no more grams than MOST_HOT are beyond it
    answers = scratch.table(_repeated_grams(keyed, span, max(48, size // BUCKET_BYTES), hot), "answers")
    heavy = [x for r in answers.filter("rid is null").collect() for x in r.hits]  # MOST_HOT at most
    hits = answers.filter("rid is not null").groupBy("rid").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    found = keyed.join(hits.hint("shuffle_hash"), "rid")
    contexts = scratch.table(_contexts(found, span, np.array(heavy, dtype=np.int64).view(np.uint64)), "contexts")
    scratch.drop("answers")
    rows = contexts.filter("key is not null").count()
    compared = scratch.table(_compared(contexts, span, max(48, rows // BUCKET_ROWS)), "compared")
    known = contexts.filter("spans is not null").select("doc", "rid", "spans")
    marks = known.unionByName(compared).groupBy("doc", "rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    df = docs.drop("removed", "kept")
    own = {"__sd_doc": F.coalesce(long_id(docs, id_col), F.lit(_NULL)), "__sd_rid": rid}
    whole = df.withColumns(own).join(marks.select(F.col("doc").alias("__sd_doc"), F.col("rid").alias("__sd_rid"), F.col("spans").alias("__sd_spans")).hint("shuffle_hash"), ["__sd_doc", "__sd_rid"], "left")
    whole = whole.select(*[F.col(f"`{c}`") for c in df.columns], "__sd_spans")
    added = [T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())]
    at, passed = df.columns.index(text_col), len(df.columns)
    out = T.StructType([*df.schema.fields, *added])
    kind = _arrow("removed array<struct<start:long,end:long>>").field("removed").type

    def cut(batches):
        for b in batches:
            removed, kept = [], []
            for t, marks in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(passed).to_pylist()):
                spans, rest, last = merged(marks or []), [], 0
                for start, end in spans:
                    rest.append((t or b"")[last:start])
                    last = end
                rest.append((t or b"")[last:])
                removed.append([{"start": s, "end": e} for s, e in spans])
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays([*b.columns[:passed], pa.array(removed, kind), pa.array(kept, pa.binary())], names=[*b.schema.names[:passed], "removed", "kept"])
        tidy()

    return whole.mapInArrow(cut, out)


def merged(flat: list[int]) -> list[tuple[int, int]]:
    """Spans as a flat list of starts and ends, in any order and overlapping, as maximal runs."""
    pairs = np.array(flat, dtype=np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    if not len(pairs):
        return []
    reach = np.maximum.accumulate(pairs[:, 1])
    opens = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    return list(zip(pairs[opens, 0].tolist(), reach[np.concatenate([opens[1:], [True]])].tolist()))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select(long_id(docs, "doc_id").alias("doc_id"), "text")
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return remove_repeats(docs).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), size.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
