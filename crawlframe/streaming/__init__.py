"""Structured Streaming jobs over the crawl log."""
