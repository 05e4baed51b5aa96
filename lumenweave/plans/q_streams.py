"""Streams and what is kept between runs: R01, R02, M24, W14."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import exposures
from lumenweave.plans.registry import query, r
from lumenweave.plans.views import pix, pix_nan, table, with_views
from lumenweave.session import shared_folder

P, N = with_views("pix"), with_views("pix_nan")


@query("r01_row_stream", f"{P} SELECT frame, y, max(v) IS NOT NULL AS there, round(max(v), 3) AS top FROM pix GROUP BY 1, 2")
def r01_stream(spark, sf):
    """All frames written as files, whose rows come as a stream of bounded micro-batches."""
    from lumenweave.sources import fits
    from lumenweave.streaming import rows

    rows.register(spark)
    folder = shared_folder(spark, "rows")
    whole = pix(spark, sf)
    fits.write_frames(whole.select("frame", "x", "y", "v"), f"{folder}/in".removeprefix("file://"), 64, 64).count()
    source = spark.readStream.format("fits_rows").option("rowsPerBatch", "128").option("stripRows", "32").load(f"{folder}/in".removeprefix("file://"))
    top = F.array_max(F.filter("data", lambda v: ~F.isnan(v)))
    frame = F.regexp_extract("file", r"(\d+)\.fits$", 1).cast("long")
    got = source.select(frame.alias("frame"), F.col("y").cast("long").alias("y"), top.cast("double").alias("top")).filter("top IS NOT NULL")
    q = got.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    q.processAllAvailable()
    q.stop()
    read = spark.read.schema(got.schema).parquet(f"{folder}/out")
    return read.select("frame", "y", F.lit(True).alias("there"), r("top", digits=3))


@query("r02_job_states")
def r02_states(spark, sf):
    """Verdicts on all events as states of jobs, from a stream that runs until it has read them; no job falls silent."""
    from lumenweave.streaming import states

    folder = shared_folder(spark, "states")
    e = table(spark, sf, "events")
    names = F.array(*[F.lit(s) for s in (*states.ORDER, *states.FINAL)])
    events = e.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")).alias("status"))
    events.write.parquet(f"{folder}/in")
    before = states.use_rocksdb(spark)
    try:
        stream = states.job_states(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), silence="100000 days")
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").groupBy("job", "status", "verdict").agg(F.count("*").alias("n"))


@query(
    "m24_incremental_exposures",
    f"""{N}, p AS (SELECT frame % 4 AS exposure, x, y FROM pix_nan WHERE isfinite(v)), e AS (SELECT DISTINCT exposure, x, y FROM p), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT exposure FROM e)),
k AS (SELECT count(*) AS pixels FROM e) SELECT 'first' AS step, n AS rebuilt, pixels FROM n, k UNION ALL SELECT 'again', 0, pixels FROM k UNION ALL SELECT 'one file changed', 1, pixels FROM k
UNION ALL SELECT 'other calibration', n, pixels FROM n, k""",
)
def m24_incremental(spark, sf):
    """Four exposures of two chips: made once, not again, one of them after a file of its changed, and all with another calibration."""
    folder = shared_folder(spark, "exposures")
    p = pix_nan(spark, sf).withColumns({"exposure": F.col("frame") % 4, "cx": F.col("x").cast("double"), "cy": F.col("y").cast("double")})
    files = p.groupBy("exposure", F.concat(F.lit("chip"), "frame").alias("path")).agg(F.count("*").alias("size")).withColumn("modified", F.lit("2026-01-01"))
    changed = files.withColumn("modified", F.when(F.col("path") == "chip6", "2026-02-02").otherwise(F.col("modified")))
    load = lambda due: p.join(due, "exposure", "left_semi")
    out = None
    for step, given, calibration in (("first", files, ""), ("again", files, ""), ("one file changed", changed, ""), ("other calibration", changed, "flat 2")):
        n = exposures.refresh(given, load, folder, calibration, kernel="point").count()
        got = exposures.current(given, folder, calibration).agg(F.count("*").alias("pixels")).select(F.lit(step).alias("step"), F.lit(n).cast("long").alias("rebuilt"), "pixels")
        one = spark.createDataFrame(got.toArrow())  # one row, before the next step replaces what it counts
        out = one if out is None else out.union(one)
    return out


@query(
    "w14_order_by_place",
    """WITH RECURSIVE c AS (SELECT s_suppkey AS input, CAST(s_suppkey // 2 AS BIGINT) AS file, s_suppkey % 2 AS chip FROM supplier),
h AS (SELECT file, min(input) AS first, CASE WHEN file % 11 <> 5 THEN CAST(file % 5 * 500 + file * 37 % 60 AS DOUBLE) END AS x, CASE WHEN file % 11 <> 5 THEN CAST(file % 3 * 700 + file * 17 % 50 AS DOUBLE) END AS y FROM c GROUP BY file),
l AS (SELECT a.first AS a, b.first AS b FROM h a JOIN h b ON a.first <> b.first AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 10000),
reach AS (SELECT first AS a, first AS b FROM h WHERE x IS NOT NULL UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
p AS (SELECT a AS first, min(b) AS place FROM reach GROUP BY 1), k AS (SELECT h.file, h.first, p.place, g.x AS px, g.y AS py FROM h LEFT JOIN p USING (first) LEFT JOIN h g ON g.first = p.place)
SELECT input, file, chip, row_number() OVER (ORDER BY CASE WHEN input = 0 THEN -1 WHEN place IS NULL THEN 2 WHEN place = 0 THEN 0 ELSE 1 END,
  CASE WHEN place IS NULL THEN 0 WHEN abs(py - 32) > 100 THEN 1 ELSE 2 END, CASE WHEN place IS NULL THEN 0 WHEN abs(py - 32) > 100 THEN py ELSE 0 END, coalesce(px, 0), coalesce(place, 0), first, chip, input) - 1 AS position
FROM c JOIN k USING (file)""",
)
def w14_place(spark, sf):
    """Suppliers as chips, two a file, whose pointings repeat over a field of fifteen tiles; each eleventh file has no place."""
    n = F.col("s_suppkey")
    file = F.floor(n / 2)
    at = lambda tiles, side, a, b: F.when(file % 11 != 5, (file % tiles * side + file * a % b).cast("double"))
    chips = table(spark, sf, "supplier").select(n.alias("input"), file.alias("file"), (n % 2).alias("chip"), at(5, 500, 37, 60).alias("x"), at(3, 700, 17, 50).alias("y"))
    return exposures.input_order(chips, 100.0, 32.0).drop("x", "y")
