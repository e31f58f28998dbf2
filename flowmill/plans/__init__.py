"""Pipelines composed of operators, and the catalogue of queries."""
