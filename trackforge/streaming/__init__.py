"""Streaming variants of the engine."""
