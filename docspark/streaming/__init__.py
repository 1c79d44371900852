"""Keyed state in batch and Structured Streaming form."""
