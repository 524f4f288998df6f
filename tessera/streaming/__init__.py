"""Structured Streaming jobs: chunked ingest, five-second windows, running scores,
early stopping."""
