"""Structured Streaming and incremental operators."""
