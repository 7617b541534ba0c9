"""Structured Streaming: ingest of recordings by day, and screening as updates arrive."""
