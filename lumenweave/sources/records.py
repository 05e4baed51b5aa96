"""Projects, alignment sidecars, offsets and labels as JSON, with the rules of older files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.operators.joins import upsert

OFFSETS = "name string, dx double, dy double, a double, b double, d double, e double, locked boolean, excluded boolean"
PROJECT = (
    "mode string, weights array<struct<id:string,red:double,green:double,blue:double>>, "
    "layers array<struct<id:string,path:string,stretch:struct<mode:string,scaled:double,beta:double,midtone:double>>>"
)


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """A composing project; one without a mode is an artistic one, and unset tuning takes its defaults."""
    p = spark.read.schema(PROJECT).option("multiLine", True).json(path)
    defaults = {"scaled": 100.0, "beta": 1.0, "midtone": 0.25}
    tuned = lambda x: F.struct(
        x["id"].alias("id"), x["path"].alias("path"),
        F.struct(F.coalesce(x["stretch"]["mode"], F.lit("Linear")).alias("mode"), *[F.when(x["stretch"][k] > 0, x["stretch"][k]).otherwise(v).alias(k) for k, v in defaults.items()]).alias("stretch"),
    )
    return p.select(F.coalesce("mode", F.lit("artistic")).alias("mode"), "weights", F.transform("layers", tuned).alias("layers"))


def invalid_weights(project: DataFrame) -> DataFrame:
    """Weights that break the rules: no id, an id that comes twice, or a share that is negative or not finite."""
    w = project.select(F.explode("weights").alias("w")).select("w.*")
    n = w.groupBy("id").agg(F.count("*").alias("n"))
    bad = [F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.abs(F.col(c)) == float("inf")) for c in ("red", "green", "blue")]
    reason = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id").when(F.col("n") > 1, "twice").when(bad[0] | bad[1] | bad[2], "share")
    return w.join(n, F.equal_null(w["id"], n["id"]), "left").drop(n["id"]).withColumn("reason", reason).filter("reason IS NOT NULL")


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Offsets from JSON, or from an older text file of ``name dx dy`` lines; a missing map is the identity."""
    if path.lower().endswith(".txt"):
        parts = F.split(F.trim("value"), r"\s+")
        rows = spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(trim(value), '#')")
        got = rows.select(parts[0].alias("name"), parts[1].try_cast("double").alias("dx"), parts[2].try_cast("double").alias("dy"))
        return got.select("name", "dx", "dy", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("d"), F.lit(1.0).alias("e"), F.lit(False).alias("locked"), F.lit(False).alias("excluded"))
    rows = spark.read.schema(OFFSETS).option("multiLine", True).json(path)
    fill = {"dx": 0.0, "dy": 0.0, "a": 1.0, "b": 0.0, "d": 0.0, "e": 1.0, "locked": False, "excluded": False}
    return rows.select("name", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in fill.items()])


def update_offsets(master: DataFrame, loaded: DataFrame) -> DataFrame:
    """The master's offsets with the loaded ones in place of those of equal name, by name."""
    return upsert(master, loaded, "name").drop("loaded").orderBy("name")


def default_regions(width: int, height: int, columns: int = 4, rows: int = 3) -> list[dict]:
    """A labelling project's regions: a grid, every third of which is for validation."""
    out = []
    for k in range(columns * rows):
        x, y = k % columns, k // columns
        out.append({"id": k, "x0": x * width // columns, "y0": y * height // rows, "x1": (x + 1) * width // columns, "y1": (y + 1) * height // rows, "split": "validation" if k % 3 == 2 else "train"})
    return out


def write_report(rows: list[dict], path: str) -> None:
    """A small report as JSON, published whole."""
    from lumenweave.sources.fits import write_bytes

    write_bytes(path, iter([json.dumps(rows, indent=1, sort_keys=True).encode()]))


def read_report(path: str):
    from lumenweave.sources import storage

    with storage.reading(path) as f:
        return json.loads(f.read())


SIDECAR = "path string, sci_ext int, width int, height int, size bigint, mtime bigint, accepted boolean, a double, b double, c double, d double, e double, f double"


def merge_sidecar(old: list[dict], new: list[dict]) -> list[dict]:
    """Alignment records by (path, sci_ext): a new one takes the place of an old one, others stay; by path and chip."""
    key = lambda r: (r["path"], r["sci_ext"])
    both = {key(r): r for r in old} | {key(r): r for r in new}
    return [both[k] for k in sorted(both)]


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records of a sidecar file; ``joins.identity_status`` tells which still belong to their files."""
    return spark.read.schema(SIDECAR).option("multiLine", True).json(path)


MOSAIC_PROJECT = "version int, reference string, inputs array<struct<path:string,dx:double,dy:double,excluded:boolean>>, settings map<string,string>"


def read_mosaic_project(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """A mosaic project's inputs (path, dx, dy, excluded, is_reference): paths inside the project's folder are relative there; no offsets are 0."""
    p = spark.read.schema(MOSAIC_PROJECT).option("multiLine", True).json(path)
    whole = lambda c: F.when(c.startswith("/") | c.contains("://"), c).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), c))
    each = p.select("reference", F.posexplode("inputs").alias("position", "i"))
    return each.select(
        "position", whole(F.col("i.path")).alias("path"), F.coalesce("i.dx", F.lit(0.0)).alias("dx"), F.coalesce("i.dy", F.lit(0.0)).alias("dy"),
        F.coalesce("i.excluded", F.lit(False)).alias("excluded"), F.coalesce(F.col("i.path") == F.col("reference"), F.lit(False)).alias("is_reference"),
    )


def invalid_regions(regions: DataFrame, width: int, height: int) -> DataFrame:
    """Regions of a labelling project (id, x0, y0, x1, y1, split) that break its rules, with the reason."""
    n = regions.groupBy("id").agg(F.count("*").alias("n"))
    outside = (F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > width) | (F.col("y1") > height)
    reason = (
        F.when(F.col("n") > 1, "twice").when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), "empty").when(outside, "outside").when(~F.col("split").isin("train", "validation"), "split")
    )
    return regions.join(n, "id").withColumn("reason", reason).filter("reason IS NOT NULL").drop("n")


def invalid_labels(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """Labels (id, x, y, kind) that lie in no region, or whose kind isn't star, not or ambiguous, with the reason."""
    box = regions.select("x0", "y0", "x1", "y1")  # a grid of a few rectangles
    inside = labels.join(F.broadcast(box), (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))).select("id").distinct().withColumn("inside", F.lit(True))
    reason = F.when(~F.col("kind").isin("star", "not", "ambiguous"), "kind").when(F.col("inside").isNull(), "region")
    return labels.join(inside, "id", "left").withColumn("reason", reason).filter("reason IS NOT NULL").drop("inside")
