"""Seismic analytics on Spark DataFrames: clean feeds, regions, clusters, daily facts, streaming."""
