"""Paged rasters: planes as tables of tiles in Parquet, replaced whole, read by rows, windows or tiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.sources import fits

TILE = "tx int, ty int, x0 int, y0 int, tile_width int, tile_height int, width int, height int, data array<float>"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Transaction:
    """A new version of a raster beside the old one: ``write`` stages it, ``commit`` puts it in the old one's place, ``abort`` drops it."""

    def __init__(self, spark: SparkSession, path: str, width: int, height: int):
        if width <= 0 or height <= 0:
            raise ValueError(f"impossible size {width} x {height}")
        self.spark, self.path, self.size = spark, path.rstrip("/"), (width, height)
        folder, _, name = self.path.rpartition("/")
        self.staged, self.old = (f"{folder}/.{name}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "old"))
        self.done = False

    def write(self, tiles: DataFrame) -> None:
        """Tile rows (tx, ty, x0, y0, tile_width, tile_height, data); rows of tiles stand together on disk."""
        width, height = self.size
        rows = tiles.select("tx", "ty", "x0", "y0", "tile_width", "tile_height", F.lit(width).alias("width"), F.lit(height).alias("height"), F.col("data").cast("array<float>").alias("data"))
        rows.sortWithinPartitions("ty", "tx").write.mode("errorifexists").parquet(self.staged)

    def _move(self, a: str, b: str) -> None:
        p, fs_ = _path(self.spark, a)
        if not fs_.rename(p, _path(self.spark, b)[0]):
            raise OSError(f"{a} can't become {b}")

    def _exists(self, path: str) -> bool:
        p, fs_ = _path(self.spark, path)
        return fs_.exists(p)

    def _drop(self, path: str) -> None:
        p, fs_ = _path(self.spark, path)
        fs_.delete(p, True)

    def commit(self) -> None:
        if self.done or not self._exists(self.staged):
            raise ValueError("the transaction is closed or has nothing to commit")
        had = self._exists(self.path)
        if had:
            self._move(self.path, self.old)
        try:
            self._move(self.staged, self.path)
        except Exception:
            if had:
                self._move(self.old, self.path)
            raise
        self.done, self.had = True, had

    def finish(self) -> None:
        """Drop the version before."""
        self._drop(self.old)

    def undo(self) -> None:
        """After a commit: the version before comes back."""
        self._drop(self.path)
        if self.had:
            self._move(self.old, self.path)

    def abort(self) -> None:
        if not self.done:
            self.done = True
            self._drop(self.staged)


def replace_all(transactions: list[Transaction]) -> None:
    """Commit several planes together: if one fails, those before it get their old versions back and the rest is dropped."""
    ended: list[Transaction] = []
    try:
        for t in transactions:
            t.commit()
            ended.append(t)
    except Exception:
        for t in reversed(ended):
            t.undo()
        for t in transactions:
            t.abort()
        raise
    for t in ended:
        t.finish()


def write(spark: SparkSession, path: str, tiles: DataFrame, width: int, height: int) -> None:
    t = Transaction(spark, path, width, height)
    t.write(tiles)
    replace_all([t])


def tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TILE).parquet(path)


def window(spark: SparkSession, path: str, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels (x, y, v) with x0 <= x < x1 and y0 <= y < y1; only the tiles that reach into the window are read."""
    t = tiles(spark, path).filter((F.col("x0") < x1) & (F.col("y0") < y1) & (F.col("x0") + F.col("tile_width") > x0) & (F.col("y0") + F.col("tile_height") > y0))
    each = t.select("x0", "y0", "tile_width", F.posexplode("data").alias("k", "v"))
    px = each.select((F.col("x0") + F.col("k") % F.col("tile_width")).alias("x"), (F.col("y0") + F.floor(F.col("k") / F.col("tile_width"))).cast("int").alias("y"), "v")
    return px.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def rows(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """Rows of pixels, as (y, values)."""
    w = tiles(spark, path).first()["width"]
    return window(spark, path, 0, first, w, first + count).groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"]).alias("values"))


def rotated_rows(spark: SparkSession, path: str, quarter_turns: int, first: int, count: int) -> DataFrame:
    """Rows of the raster turned clockwise by quarter turns, read without turning the whole: (y, values)."""
    t = tiles(spark, path).first()
    w, h, q = t["width"], t["height"], quarter_turns % 4
    if q == 0:
        return rows(spark, path, first, count)
    last = first + count
    box = {1: (first, 0, last, h), 2: (0, h - last, w, h - first), 3: (w - last, 0, w - first, h)}[q]
    x, y = F.col("x"), F.col("y")
    turned = {1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[q]
    px = window(spark, path, *box).select(turned[0].alias("tx"), turned[1].alias("ty"), "v")
    return px.groupBy(F.col("ty").alias("y")).agg(F.transform(F.array_sort(F.collect_list(F.struct("tx", "v"))), lambda p: p["v"]).alias("values"))


def copy_plane(spark: SparkSession, source: str, path: str, extname: str = "", extver: int | None = None, normalised: bool = False, tile: int = 256) -> None:
    """A plane of a raster file as a paged raster, as it is or (v - lo) / (hi - lo) of its finite samples, where an empty range counts as 1."""
    from lumenweave.functions.scalars import finite

    fits.register(spark)
    reader = spark.read.format("fits").option("tileSize", str(tile)).option("extname", extname)
    if extver is not None:
        reader = reader.option("extver", str(extver))
    t = reader.load(source).filter(F.col("data").isNotNull())
    one = t.select("hdu", "width", "height").distinct().orderBy("hdu").first()
    if one is None:
        raise ValueError(f"{source} has no plane {extname!r}")
    t = t.filter(F.col("hdu") == one["hdu"])
    if normalised:
        each = t.select(F.explode("data").alias("v")).filter(finite(F.col("v"))).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        lo = each["lo"] or 0.0
        span = (each["hi"] or 0.0) - lo or 1.0
        t = t.withColumn("data", F.transform("data", lambda v: (v - lo) / span))
    write(spark, path, t, one["width"], one["height"])
