"""Behavioural alert analytics on Spark DataFrames."""
