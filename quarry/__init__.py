"""Hybrid document retrieval and text-collection processing on Spark DataFrames."""

__version__ = "0.1.0"
