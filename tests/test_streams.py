"""Streams: image rows that are read once each across a restart, and job states with late and silent jobs."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.sources import fits
from lumenweave.streaming import rows, states


def write(path, height, number):
    a = (np.arange(height * 5, dtype=np.float32) + 1000 * number).reshape(height, 5)
    mask = (np.arange(6, dtype=np.int32) + number).reshape(2, 3)
    fits.write_file(str(path), [("SCI", a, {}), ("DQ", mask, {})])


def test_rows_come_once_across_a_restart(spark, tmp_path):
    rows.register(spark)
    landing, out = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    for k, height in enumerate((7, 30, 4)):
        write(landing / f"f{k}.fits", height, k)
    stopped = {"at": 2}
    sizes = {}

    def keep(batch, number):
        if number == stopped["at"]:
            raise RuntimeError("the driver is lost")
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        sizes[number] = spark.read.parquet(f"{out}/{number}").count()

    def run():
        source = spark.readStream.format("fits_rows").option("rowsPerBatch", "8").option("stripRows", "4").load(str(landing))
        return source.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).start()

    q = run()
    with pytest.raises(Exception, match="driver is lost"):
        q.processAllAvailable()
    assert set(sizes) == {0, 1}
    stopped["at"] = None
    write(landing / "f3.fits", 9, 3)
    q = run()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(*[f"{out}/{n}" for n in sorted(os.listdir(out))]).collect()
    seen = sorted((os.path.basename(r.file), r.hdu, r.y) for r in got)
    want = sorted((f"f{k}.fits", hdu, y) for k, height in enumerate((7, 30, 4, 9)) for hdu, n in ((0, height), (1, 2)) for y in range(n))
    assert seen == want and max(sizes.values()) <= 8 + 4 and len(sizes) >= 6
    one = next(r for r in got if r.file.endswith("f1.fits") and r.hdu == 0 and r.y == 29)
    assert one.data == [1145.0, 1146.0, 1147.0, 1148.0, 1149.0] and one.exact is None
    assert next(r for r in got if r.file.endswith("f2.fits") and r.hdu == 1 and r.y == 1).exact == [5, 6, 7]


def test_legal_transitions():
    assert states.legal(None, "aligning") and states.legal("pending", "saving") and states.legal("loading", "cancelled")
    assert not states.legal("saving", "loading") and not states.legal("loading", "loading") and not states.legal("failed", "pending") and not states.legal("pending", "odd")


def test_states_late_events_and_silence(spark, tmp_path):
    before = states.use_rocksdb(spark)
    try:
        t = lambda minute: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute)
        batches = [
            [(1, t(0), "pending"), (1, t(1), "loading"), (2, t(0), "pending"), (3, t(2), "saving"), (3, t(3), "loading")],
            [(1, t(30), "succeeded"), (3, t(31), "succeeded"), (3, t(32), "failed")],
            [(2, t(5), "loading"), (4, t(200), "pending")],  # job 2's event comes behind the watermark of 22 minutes
            [(4, t(201), "loading")],
        ]
        folder = tmp_path / "in"
        out = []
        schema = "job long, ts timestamp, status string"

        def run():
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
            q = states.job_states(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
            return q.foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start()

        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
            run().awaitTermination()
        got = {(r.job, r.before, r.status, r.verdict) for r in out}
        assert {(1, None, "pending", "moved"), (1, "pending", "loading", "moved"), (1, "loading", "succeeded", "moved")} <= got
        assert {(3, None, "saving", "moved"), (3, "saving", "loading", "refused"), (3, "saving", "succeeded", "moved"), (3, "succeeded", "failed", "refused")} <= got
        assert (2, "pending", "failed", "silent") in got and not any(r.job == 2 and r.status == "loading" for r in out)
        assert {r[3] for r in got if r[0] == 4} == {"moved"} and len(out) == len(got)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_the_state_of_a_stream_is_what_a_loop_gives(spark, tmp_path):
    """All events of the table at once: each job's verdicts in the order of its events."""
    before = states.use_rocksdb(spark)
    try:
        e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
        names = F.array(*[F.lit(s) for s in (*states.ORDER, *states.FINAL)])
        events = e.select((F.col("user_id") % 50).alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")).alias("status"))
        events.write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        out = []
        q = states.job_states(stream, silence="100000 days").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        q.foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
        want, held = [], {}
        for r in sorted(events.collect(), key=lambda r: (r.job, r.ts, r.status)):
            good = states.legal(held.get(r.job), r.status)
            want.append((r.job, r.ts, held.get(r.job), r.status, "moved" if good else "refused"))
            if good:
                held[r.job] = r.status
        key = lambda x: tuple(str(v) for v in x)
        assert sorted(map(tuple, out), key=key) == sorted(want, key=key) and len(want) == events.count()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_query_of_job_states(spark):
    from collections import Counter

    from conftest import SF

    from lumenweave.plans.queries import QUERIES

    names, held, want = (*states.ORDER, *states.FINAL), {}, Counter()
    events = [(r.user_id, r.ts, names[r.event_id % 8]) for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    for job, ts, status in sorted(events):
        good = states.legal(held.get(job), status)
        want[job, status, "moved" if good else "refused"] += 1
        if good:
            held[job] = status
    assert {(r.job, r.status, r.verdict): r.n for r in QUERIES["r02_job_states"](spark, SF).collect()} == want
