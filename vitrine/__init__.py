"""Slate click-log analytics on Spark DataFrames."""
