"""Structured Streaming: growing an index by micro-batches."""
