"""Lossless, block-wise log analytics and training-data operators on Spark DataFrames."""
