"""Incremental forms on Structured Streaming, drained on demand."""
