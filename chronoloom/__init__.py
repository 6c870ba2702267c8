"""Chronoloom: keyed time series on PySpark DataFrames."""
