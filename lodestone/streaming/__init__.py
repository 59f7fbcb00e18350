"""Ordered change logs: merge, replay and micro-batches."""
