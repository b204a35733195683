"""Monitoring-style analytics on Spark DataFrames."""
