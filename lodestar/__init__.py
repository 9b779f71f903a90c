"""Lodestar: evidence retrieval and snapshot analytics on PySpark DataFrames."""
