"""Interval and variant analytics on Spark DataFrames."""
