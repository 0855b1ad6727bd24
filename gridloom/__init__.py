"""gridloom: tiled raster and vector processing on Spark DataFrames."""

__version__ = "0.1.0"
