"""gridloom: Spark-native analytics over label rasters and the tables derived from them."""

__version__ = "0.1.0"
