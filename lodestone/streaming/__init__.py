"""Streaming upkeep of the index."""
