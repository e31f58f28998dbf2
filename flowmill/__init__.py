"""Profiling, cleaning, sampling, modelling and drift operators for wide labelled tables, on Spark DataFrames."""
