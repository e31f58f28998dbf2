"""Structured Streaming over the same operators."""
