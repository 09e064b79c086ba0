"""Structured Streaming: change feeds, topics, windowed rollups, duplicates and expiry."""
