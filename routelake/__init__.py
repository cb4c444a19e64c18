"""Routing and storage-movement analytics on Spark DataFrames."""
