"""lumenweave: raster and catalog analytics expressed in Spark DataFrames."""
