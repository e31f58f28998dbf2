"""Operators: each takes DataFrames and returns one; labels, keys, thresholds and seeds are arguments."""
