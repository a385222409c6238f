"""Raster analytics on Spark DataFrames: files, tags, blocks and pixels as tables."""
