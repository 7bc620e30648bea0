"""Catalith: catalog-monitoring analytics on Spark DataFrames."""
