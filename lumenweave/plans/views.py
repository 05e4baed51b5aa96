"""Raster, catalog and file views over the supplied tables, each as a DataFrame and as SQL.

Rasters are long tables (frame, x, y, ...), one row a pixel; keys are unique because every view
aggregates first. Values are rounded in the view, so that sums in another order see equal inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.plans.registry import snap
from lumenweave.session import ship_package

NAN = float("nan")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frames of 64 x 64 pixels: value, error, bit mask."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 8).alias("frame"),
        (F.col("l_partkey") % 64).alias("x"),
        (F.col("l_orderkey") % 64).alias("y"),
        "l_extendedprice", "l_tax", F.expr("shiftleft(1, l_linenumber)").alias("bit"),
    )
    return rows.groupBy("frame", "x", "y").agg(
        snap(F.avg("l_extendedprice") / 1000, 4).alias("v"), snap(1 + F.avg("l_tax"), 4).alias("err"), F.bit_or("bit").cast("long").alias("dq")
    )


def pix_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pix`` with missing samples as NaN."""
    return pix(spark, sf_dir).withColumn("v", F.when((F.col("x") * 7 + F.col("y")) % 31 == 0, F.lit(NAN)).otherwise(F.col("v")))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of detections: frame, star, x, y, flux, peak, area, exposure."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("frame"),
        F.col("event_id").alias("star"),
        snap((F.col("value") * 13) % 256, 3).alias("x"),
        ((F.col("event_id") * 7) % 256).cast("double").alias("y"),
        snap(F.col("value"), 4).alias("flux"),
        snap(F.col("value") / (1 + F.col("event_id") % 5), 4).alias("peak"),
        (1 + F.col("event_id") % 40).alias("area"),
        (F.col("user_id") % 6).alias("exposure"),
    )


PRIORITY_FILTER = (("1-URGENT", "F606W"), ("2-HIGH", "F814W"), ("3-MEDIUM", "F435W"), ("4-NOT SPECIFIED", "F110W"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file catalog: path, filter, proposal, exposure label, observation date ('' where unknown), instrument."""
    name = F.lit("F160W")
    for priority, f in PRIORITY_FILTER:
        name = F.when(F.col("o_orderpriority") == priority, f).otherwise(name)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("_flc", "_flt", "_cal", "_raw", "_FLC_x", "N2020")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), kind, F.lit(".fits")).alias("path"),
        name.alias("filter"),
        (F.col("o_custkey") % 20 + 9970).cast("string").alias("proposal"),
        F.concat(F.floor(F.col("o_totalprice") / 20000 + 1).cast("long").cast("string"), F.lit("s")).alias("exposure"),
        F.when(F.col("o_orderkey") % 17 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_obs"),
        F.when(F.col("o_orderstatus") == "F", "ACS").when(F.col("o_orderstatus") == "O", "WFC3").otherwise("").alias("instrument"),
    )


#: The same views in SQL, as common table expressions.
SQL = {
    "pix": """pix AS (SELECT l_suppkey % 8 AS frame, l_partkey % 64 AS x, l_orderkey % 64 AS y, round(avg(l_extendedprice) / 1000, 4) AS v,
  round(1 + avg(l_tax), 4) AS err, CAST(bit_or(1 << l_linenumber) AS BIGINT) AS dq FROM lineitem GROUP BY 1, 2, 3)""",
    "pix_nan": """pix_nan AS (SELECT frame, x, y, CASE WHEN (x * 7 + y) % 31 = 0 THEN CAST('NaN' AS DOUBLE) ELSE v END AS v, err, dq FROM pix)""",
    "stars": """stars AS (SELECT user_id % 8 AS frame, event_id AS star, round((value * 13) % 256, 3) AS x, CAST((event_id * 7) % 256 AS DOUBLE) AS y,
  round(value, 4) AS flux, round(value / (1 + event_id % 5), 4) AS peak, 1 + event_id % 40 AS area, user_id % 6 AS exposure FROM events)""",
    "files": """files AS (SELECT o_orderkey AS file_id, 'f' || o_orderkey || ['_flc', '_flt', '_cal', '_raw', '_FLC_x', 'N2020'][o_orderkey % 6 + 1] || '.fits' AS path,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'F606W' WHEN '2-HIGH' THEN 'F814W' WHEN '3-MEDIUM' THEN 'F435W' WHEN '4-NOT SPECIFIED' THEN 'F110W' ELSE 'F160W' END AS filter,
  CAST(o_custkey % 20 + 9970 AS VARCHAR) AS proposal, CAST(floor(o_totalprice / 20000 + 1) AS BIGINT) || 's' AS exposure,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_obs,
  CASE o_orderstatus WHEN 'F' THEN 'ACS' WHEN 'O' THEN 'WFC3' ELSE '' END AS instrument FROM orders)""",
}


def with_views(*names: str) -> str:
    """The WITH clause of some views and what they stand on."""
    need = []
    for n in names:
        if n == "pix_nan" and "pix" not in need:
            need.append("pix")
        if n not in need:
            need.append(n)
    return "WITH " + ", ".join(SQL[n] for n in need)
