"""Operator 7: sharding by balanced label propagation.

Rows start in shards of equal counts. In each round a group of equal texts names the shards that hold
most of it (as many as it needs), its rows elsewhere ask to move there, and quotas let a row move only
against one that moves the other way: another asking row, or a row without links, which may stand
anywhere. So counts never change, and the rows that are away from their group (what the cut costs) only fall,
which each round checks. Rounds go on until none may move, or one settles so few that a plan does it better.

Where that leaves groups in more shards than they need, these and the rows without links vacate their
places and are put back by a plan, largest groups first; if even that cuts a group, all rows are. The
plan knows groups by size alone, so the driver sees a row a size, and a row a group only of large ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table
from .ranks import ranked


PART = 4096  # rows of one group that meet in one task, about
LARGE = 1000  # members from which a group's rows are ranked in many buckets


def move_quotas(asked: dict[tuple[int, int], int], free: dict[int, int]) -> tuple[dict[tuple[int, int], int], dict[int, list[tuple[int, int]]]]:
    """How many asking rows may go from shard to shard, and which free rows, by rank, make room: shard -> [(to, how many)]."""
    allowed = {k: min(n, asked.get(k[::-1], 0)) for k, n in asked.items()}
    left, back = dict(free), {}
    for (a, b), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - allowed[a, b], left.get(b, 0))
        if more > 0:
            allowed[a, b] += more
            left[b] -= more
            back.setdefault(b, []).append((a, more))
    return {k: n for k, n in allowed.items() if n}, back


def settle(groups: list[tuple[int, str, int]], room: dict[int, int], whole: int) -> tuple[list[tuple[int, str, int, int, int]], int]:
    """Places of groups (members, name, how many such) in shards' rooms, which they fill: runs (members, name, from, to, shard) of the
    rows of a size in the groups' order; and how many groups are in more shards, of ``whole`` rows each, than their size needs.

    A group goes whole to the shard with least room for it. One that fits nowhere waits until all others are placed; when the
    smallest of these was tried each room was less than it, so without rows alone they are fewer than the shards.
    """
    left, runs, waiting, cut = dict(room), [], [], 0
    most = max(room.values())

    def spread(k, name, at):
        end, parts = at + k, 0
        while at < end:
            fits = [s for s in left if left[s] >= end - at]
            s = min(fits, key=lambda s: (left[s], s)) if fits else max(left, key=lambda s: (left[s], -s))
            n = min(left[s], end - at)
            runs.append((k, name, at, at + n, s))
            left[s] -= n
            at, parts = at + n, parts + 1
        return parts > -(-k // whole)

    for k, name, n in sorted((g for g in groups if g[0] > 1), key=lambda g: (-g[0], g[1])):
        at = 0
        while n:
            fits = [s for s in left if left[s] >= k]
            if fits:
                s = min(fits, key=lambda s: (left[s], s))
                c = min(n, left[s] // k)
                runs.append((k, name, at, at + c * k, s))
                left[s] -= c * k
                at, n = at + c * k, n - c
            elif k > most:
                cut += spread(k, name, at)
                at, n = at + k, n - 1
            else:
                waiting.append((k, name, at, n))
                n = 0
    for k, name, at, n in waiting:
        for i in range(n):
            cut += spread(k, name, at + i * k)
    for k, name, n in groups:
        at = 0
        for s in sorted(left) if k == 1 else ():
            c = min(n - at, left[s])
            if c:
                runs.append((k, name, at, at + c, s))
                left[s] -= c
                at += c
    return runs, cut


def settled(state: DataFrame, scratch: Scratch, room: int, buckets: int) -> DataFrame:
    """``state`` with the groups that the rounds left in more shards than they need put together, as far as counts allow."""
    spark = state.sparkSession
    held = state.filter("members > 1").select("g", "members", "shard").distinct().groupBy("g", "members").agg(F.count("*").alias("held"))
    apart = scratch.table(held.filter(F.col("held") > F.ceil(F.col("members") / room)).select("g", F.lit(True).alias("apart")), "apart")
    n_apart = apart.count()
    if not n_apart:
        return state
    name = F.when(F.col("members") > LARGE, F.col("g")).otherwise("").alias("name")
    pool = scratch.table(state.join(apart, "g", "left").select(*state.columns, name, (F.col("apart").isNotNull() | (F.col("members") == 1)).alias("moves")), "pool")
    sizes = pool.groupBy("members", "name", "moves").count().collect()  # a row a size up to LARGE, and a row a larger group
    rooms = pool.groupBy("shard", "moves").count().collect()
    for every in (False, True):
        groups: dict[tuple[int, str], int] = {}
        for r in sizes:
            if every or r["moves"]:
                groups[r["members"], r["name"]] = groups.get((r["members"], r["name"]), 0) + r["count"] // r["members"]
        vacated: dict[int, int] = {}
        for r in rooms:
            if every or r["moves"]:
                vacated[r["shard"]] = vacated.get(r["shard"], 0) + r["count"]
        runs, cut = settle([(k, g, n) for (k, g), n in groups.items()], vacated, room)
        if not cut:
            break
    if cut >= n_apart:
        return state
    going, staying = (pool, None) if every else (pool.filter("moves"), pool.filter("NOT moves").select(*state.columns))
    to = spark.createDataFrame(runs, "members long, name string, lo long, hi long, to int")
    # all rows of a group follow each other, as the size's groups do; a large group is alone under its name
    key = F.when(F.col("name") == "", F.xxhash64("g")).otherwise(F.xxhash64("row"))
    put = ranked(going, ["members", "name"], ["g", "row"], key, buckets, "rank").join(F.broadcast(to), ["members", "name"]).filter("rank >= lo AND rank < hi")
    put = put.select(*[F.col("to").alias(c) if c == "shard" else F.col(c) for c in state.columns])
    return scratch.table(put if staying is None else put.union(staying), "settled")


def shard_rows(
    docs: DataFrame, shards: int = 16, gain: float = 0.05, id_col: str = "doc_id", text_col: str = "text", cuts: list[int] | None = None
) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes plus 1), text_crc32, law (``rows``), shard, slot, grown_shard (null).

    Shards' row counts differ by one at most. Rows of equal text are linked (a null text counts as empty)
    and share a shard as far as counts allow: of the groups that fit in a shard, fewer are cut than there
    are shards. A group larger than a shard takes as few shards as it needs where those are free. Slots run from 0 in each shard.

    Rounds end when none of the rows away from their group may move, or fewer than a share ``gain`` of them; the plan settles what is left. ``cuts``
    gets the number of such rows before each round; it never rises.

    Repeated rows and null ids are rows like any other, and ids may be of any type. A very long text counts by its size alone. Ties between shards
    go by hash. With fewer rows than shards some shards are empty; an empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    raw = F.coalesce(F.encode(F.col(f"`{text_col}`"), "UTF-8"), F.lit(b""))
    slim = scratch.table(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.md5(raw).alias("g"),
        ),
        "slim",
    )
    total = slim.count()
    buckets = max(16, -(-total // 200_000))
    # a table of its own, so that the join's large side can be split where a text is very common
    members = scratch.table(slim.groupBy("g").agg(F.count("*").alias("members")).filter("members > 1"), "members")
    spread = F.xxhash64("doc_id", "g", "size")
    start = ranked(slim, [], ["doc_id", "g"], spread, buckets, "row")
    # the group table has no row for texts that stand alone
    state = scratch.table(
        start.join(members, "g", "left").select(
            "row", "doc_id", "size", "text_crc32", "g", F.coalesce("members", F.lit(1)).alias("members"), (F.col("row") % shards).cast("int").alias("shard")
        ),
        "state-0",
    )
    room = max(1, total // shards)
    parts = F.ceil(F.col("members") / PART)  # a large group meets its shards in as many parts
    n, before = 0, None
    while True:
        n += 1
        linked = state.filter("members > 1")
        want = (
            linked.groupBy("g", "members", "shard")
            .agg(F.count("*").alias("here"))
            .groupBy("g", "members")
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("here")).alias("less"), F.pmod(F.xxhash64("g", "shard"), F.lit(997)).alias("tie"), "shard"))).alias("by"))
            .select("g", F.slice(F.transform("by", lambda x: x["shard"]), F.lit(1), F.ceil(F.col("members") / room).cast("int")).alias("wanted"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        )
        asking = linked.withColumn("part", F.pmod(F.col("row"), parts)).join(want, ["g", "part"]).filter(~F.array_contains("wanted", F.col("shard")))
        asking = scratch.table(
            asking.select("row", "g", "members", "shard", F.element_at("wanted", (F.pmod(F.xxhash64("row"), F.size("wanted")) + 1).cast("int")).alias("to")),
            f"asking-{n}",
        )
        asked = {(r["shard"], r["to"]): r["count"] for r in asking.groupBy("shard", "to").count().collect()}  # shards ** 2 rows
        away = sum(asked.values())
        if before is not None and away > before:
            raise RuntimeError(f"rows away from their group rose from {before} to {away}")
        if cuts is not None:
            cuts.append(away)
        if not away:
            break
        free = {r["shard"]: r["count"] for r in state.filter("members = 1").groupBy("shard").count().collect()}
        allowed, back = move_quotas(asked, free)
        if sum(allowed.values()) < gain * away:
            break
        before = away
        quota = spark.createDataFrame([(a, b, k) for (a, b), k in allowed.items()], "shard int, to int, quota long")
        # a group's rows stand together, so quotas cut few groups; a very large one is spread over buckets
        key = F.xxhash64("g") + F.when(F.col("members") > 1000, F.pmod(F.col("row"), F.lit(buckets))).otherwise(0)
        going = ranked(asking, ["shard", "to"], ["g", "row"], key, buckets, "rank").join(F.broadcast(quota), ["shard", "to"]).filter("rank < quota").select("row", "to")
        if back:
            spans = [(b, a, sum(k for _, k in turns[:i]), sum(k for _, k in turns[: i + 1])) for b, turns in back.items() for i, (a, _) in enumerate(turns)]
            most = {b: max(s[3] for s in spans if s[0] == b) for b in back}
            making = spark.createDataFrame(spans, "shard int, to int, lo long, hi long")
            out = state.filter(F.col("members") == 1).filter(F.col("shard").isin(list(most))).select("row", "shard")
            out = ranked(out, ["shard"], ["row"], F.xxhash64("row"), buckets, "rank")
            going = going.union(
                out.join(F.broadcast(making), "shard").filter("rank >= lo AND rank < hi").select("row", "to")
            )
        state = scratch.table(state.join(going, "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), f"state-{n}")
        scratch.drop(f"state-{n - 1}", f"asking-{n}")
    state = settled(state, scratch, room, buckets)
    placed = ranked(state, ["shard"], ["row"], F.xxhash64("row"), buckets, "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents"))
