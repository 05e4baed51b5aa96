"""Exposures of several chips combined once and kept: a manifest says what each was made of, and only those whose files, calibration or version changed are made again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.scalars import finite
from lumenweave.operators import combine
from lumenweave.session import settled

MANIFEST = "exposure long, fingerprint string, files long"


def fingerprints(files: DataFrame, calibration: str = "", version: int = 1) -> DataFrame:
    """(exposure, fingerprint, files) of files (exposure, path, size, modified): one hash of all that an exposure is made of, whatever the order of its files."""
    one = F.sha2(F.to_json(F.struct("path", "size", F.col("modified").cast("string").alias("modified"))), 256)
    every = F.concat_ws(",", F.array_sort(F.collect_list(one)))  # a row a chip of one exposure
    return files.groupBy("exposure").agg(F.sha2(F.concat_ws("|", F.lit(str(version)), F.lit(calibration), every), 256).alias("fingerprint"), F.count("*").alias("files"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder.rstrip('/')}/manifest", MANIFEST)


def stale(wanted: DataFrame, kept: DataFrame) -> DataFrame:
    """Exposures of ``wanted`` (``fingerprints``) that ``kept`` (a manifest) doesn't have in this state."""
    return wanted.join(kept.select("exposure", "fingerprint"), ["exposure", "fingerprint"], "left_anti")


def combined(pixels: DataFrame, kernel: str = "square", drop: float = 1.0) -> DataFrame:
    """Chips' samples (exposure, frame, cx, cy, v, err, dq) on each exposure's own grid: (exposure, ox, oy, v, weight, inputs, dq), weighted by inverse variance."""
    weight = F.when(F.col("err") > 0, 1 / (F.col("err") * F.col("err"))).otherwise(1.0) * F.col("kw")
    k = combine.scatter(pixels.filter(finite(F.col("v"))), kernel, drop)
    sums = k.groupBy("exposure", "ox", "oy").agg(F.sum(F.col("v") * weight).alias("vw"), F.sum(weight).alias("weight"), F.countDistinct("frame").alias("inputs"), F.bit_or("dq").alias("dq"))
    return sums.filter(F.abs("weight") > 1e-12).select("exposure", "ox", "oy", (F.col("vw") / F.col("weight")).alias("v"), "weight", "inputs", "dq")


DATA = "exposure long, ox long, oy long, v double, weight double, inputs long, dq long"


def refresh(files: DataFrame, load: Callable[[DataFrame], DataFrame], folder: str, calibration: str = "", version: int = 1, **how) -> DataFrame:
    """Bring the kept exposures in ``folder`` up to date and return what was made again (exposure, fingerprint, files).

    ``load`` gives the samples (``combined``) of a table of exposures: it is asked for the stale ones alone. Each exposure is a partition of the kept table and is
    replaced whole; the manifest's rows follow behind the data, so a run that is lost between the two makes those exposures again and loses none.
    """
    folder = folder.rstrip("/")
    due = stale(fingerprints(files, calibration, version), manifest(files.sparkSession, folder))
    todo = settled(due, "stale")  # stays as it is while the manifest is replaced
    if todo.isEmpty():
        return todo
    only_these = {"mode": "overwrite", "partitionBy": "exposure"}
    combined(load(todo.select("exposure")), **how).write.option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/data", **only_these)
    todo.write.option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/manifest", **only_these)
    return todo


def current(files: DataFrame, folder: str, calibration: str = "", version: int = 1) -> DataFrame:
    """The kept exposures of these files that are up to date; what other files or settings made is left out."""
    spark, folder = files.sparkSession, folder.rstrip("/")
    good = fingerprints(files, calibration, version).join(manifest(spark, folder).select("exposure", "fingerprint"), ["exposure", "fingerprint"], "left_semi")
    return _read(spark, f"{folder}/data", DATA).join(good.select("exposure"), "exposure", "left_semi")


# --- order ----------------------------------------------------------------------------------------


def input_order(chips: DataFrame, radius: float, middle: float) -> DataFrame:
    """``chips`` (input, file, chip, x, y) with ``position``: files of one place together, places in order along the mosaic.

    x, y are where a file's first chip has its centre in the grid of input 0; files without one come last, as they came. Files whose centres hang together by steps of
    ``radius`` are one place. Input 0 is first, then the rest of its place, then places that lie off the ``middle`` row by more than the radius, by row, then the others by
    column; a place stands where its first file does. Chips of a file keep together, by their number.
    """
    from lumenweave.operators.graph import connected
    from lumenweave.operators.index import global_index
    from lumenweave.operators.joins import radius_join

    files = chips.groupBy("file").agg(F.min("input").alias("first"), *[F.min_by(c, F.struct("chip", "input")).alias(c) for c in "xy"])
    there = files.filter("x IS NOT NULL AND y IS NOT NULL")
    # files at one spot are one, and so are spots of a cell whose diagonal is the radius; between cells one pair is enough
    spots = there.groupBy("x", "y").agg(F.min("first").alias("first"))
    side = radius / 2**0.5 * (1 - 1e-9)
    spots = settled(spots.withColumns({"gx": F.floor(F.col("x") / side), "gy": F.floor(F.col("y") / side)}), "spots")
    cells = spots.groupBy("gx", "gy").agg(F.min("first").alias("a"))
    at = cells.join(spots, ["gx", "gy"]).select("a", "x", "y")
    near = radius_join(at, at, radius).filter("a < r_a").select("a", F.col("r_a").alias("b")).distinct()
    heads = connected(near)
    of_cell = cells.join(heads, cells["a"] == heads["id"], "left").select("gx", "gy", F.coalesce("component", "a").alias("place"))
    of_spot = spots.join(of_cell, ["gx", "gy"]).select("x", "y", "place")
    placed = there.join(of_spot, ["x", "y"]).select("file", "first", "x", "y", "place")
    # a component is named by its least member, which is its first file
    head = placed.filter("first = place").select("place", F.col("x").alias("px"), F.col("y").alias("py"))
    off = F.abs(F.col("py") - middle) > radius
    ranks = {
        "k0": F.when(F.col("place") == 0, 0).otherwise(1), "k1": F.when(off, 1).otherwise(2), "k2": F.when(off, F.col("py")).otherwise(0.0), "k3": F.col("px"), "k4": F.col("place").cast("double"),
    }
    known = placed.join(head, "place").select("file", "first", *[v.cast("double").alias(k) for k, v in ranks.items()])
    lost = files.join(there.select("file"), "file", "left_anti").select("file", "first", F.lit(2.0).alias("k0"), *[F.lit(0.0).alias(f"k{n}") for n in range(1, 5)])
    rows = chips.join(known.unionByName(lost), "file").withColumn("own", F.when(F.col("input") == 0, -1).otherwise(F.col("chip")))
    lead = F.when(F.col("input") == 0, -1.0).otherwise(F.col("k0"))
    rows = rows.withColumn("k0", lead)
    return global_index(rows, ["k0", "k1", "k2", "k3", "k4", "first", "own", "input"], "position").select(*chips.columns, "position")
