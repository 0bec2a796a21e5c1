"""Layerstone: versioned key-value analytics on Spark DataFrames."""
