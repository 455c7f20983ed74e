"""Structured Streaming over events; an addition to the batch operators."""
