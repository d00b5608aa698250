"""Spatial map analytics on Spark DataFrames."""
