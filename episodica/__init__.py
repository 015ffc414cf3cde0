"""Spark-native episodic memory engine: an episode log queried as ordinary DataFrames."""

__version__ = "0.1.0"
