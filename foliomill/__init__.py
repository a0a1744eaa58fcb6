"""Page-corpus analytics on Spark: scanned pages as tables of raster strips."""
