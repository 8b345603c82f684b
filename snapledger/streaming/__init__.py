"""Structured Streaming over snapshot manifests."""
