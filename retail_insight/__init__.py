"""Retail purchase analytics on Spark DataFrames."""
