"""Command line: ``python -m lumenweave headers PATH``, ``starmap PATH OUT``, ``starstretch PATH MAP OUT``, ``query NAME FOLDER [--out DIR]``, ``queries``."""

from __future__ import annotations

import argparse

from pyspark.sql import Window


def science(spark, path: str):
    """(pixels frame, x, y, v; width, height) of a file's primary plane."""
    from pyspark.sql import functions as F

    from lumenweave.sources import fits

    fits.register(spark)
    tiles = spark.read.format("fits").option("hdu", "0").load(path)
    one = tiles.select("width", "height").first()
    px = fits.pixels(tiles).select(F.lit(0).cast("long").alias("frame"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("double").alias("v"))
    return px, one["width"], one["height"]


def star_map(spark, path: str, out: str) -> int:
    """Detect, fit and save the stars of a mosaic; returns how many."""
    from pyspark.sql import functions as F

    from lumenweave.operators import detect, stats
    from lumenweave.session import settled
    from lumenweave.sources import products

    px, width, height = science(spark, path)
    levels = stats.background(px, ["frame"])
    found = settled(detect.star_map(px, detect.extract_stars(px, levels), levels), "starmap")
    table = found.select(
        F.row_number().over(Window.orderBy("y", "x")).alias("id"), "x", "y", "fwhm", "radius", "snr", "residual", "amplitude", "status", F.lit("").alias("reason"), F.lit(False).alias("saturated"),
        F.lit(0).alias("usable"), F.lit(0).alias("confirmed"), F.lit("").alias("override"),
    ).fillna(0.0)
    table = settled(table, "starmap")
    products.save_star_map(table, px.select("x", "y", "v"), out, width, height, {"algorithm": "local", "inputs": [path]})
    return table.count()


def star_stretch(spark, path: str, star_map_path: str, out: str, strength: float) -> None:
    """A mosaic scaled to 0..1 with its accepted stars' excess drawn in, as a file of one plane."""
    from pyspark.sql import functions as F

    from lumenweave.operators import detect, stats
    from lumenweave.sources import fits, products

    px, width, height = science(spark, path)
    stars, _, _ = products.read_star_map(spark, star_map_path, px.select("x", "y", "v"), width, height)
    lo, hi = stats.auto_levels(px, []).select("lo", "hi").first()
    unit = px.withColumn("v", (F.col("v") - lo) / (hi - lo))
    bg = (stats.background(px, []).first()["bg"] - lo) / (hi - lo)
    src = stars.filter(products.accepted(F.col("status"), F.col("override"))).select(F.lit(0).cast("long").alias("frame"), "x", "y", "radius", F.lit(bg).alias("base"))
    fits.write_sorted(detect.gentler(unit, src, strength).select("x", "y", "v"), out, width, height, [("v", "", False)])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lumenweave")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("headers", help="list the header units of raster files")
    a.add_argument("path")
    a = sub.add_parser("starmap", help="find a mosaic's stars and write their map")
    a.add_argument("path")
    a.add_argument("out")
    a = sub.add_parser("starstretch", help="write a mosaic with its mapped stars treated gently")
    a.add_argument("path")
    a.add_argument("map")
    a.add_argument("out")
    a.add_argument("--strength", type=float, default=0.5)
    a = sub.add_parser("query", help="run a registered query on a folder of tables")
    a.add_argument("name")
    a.add_argument("folder")
    a.add_argument("--out")
    a.add_argument("--rows", type=int, default=20)
    sub.add_parser("queries", help="name the registered queries")
    args = p.parse_args(argv)
    from lumenweave.plans.queries import QUERIES

    if args.what == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    from lumenweave.session import session

    spark = session()
    if args.what == "headers":
        from lumenweave.sources.products import list_headers

        list_headers(spark, args.path).show(1000, truncate=False)
    elif args.what == "starmap":
        print(star_map(spark, args.path, args.out), "stars")
    elif args.what == "starstretch":
        star_stretch(spark, args.path, args.map, args.out, args.strength)
    elif args.name not in QUERIES:
        print(f"no query {args.name}")
        return 1
    elif args.out:
        QUERIES[args.name](spark, args.folder).write.mode("errorifexists").parquet(args.out)
    else:
        QUERIES[args.name](spark, args.folder).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
