"""Gridwright: tabular preparation, profiling and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
