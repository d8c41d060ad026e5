"""Structured Streaming: the ingestion queue, sessions and conversations as streams."""
