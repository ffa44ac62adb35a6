"""Structured Streaming form of the settlement."""
