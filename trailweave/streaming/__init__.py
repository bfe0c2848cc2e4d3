"""Structured Streaming over fixes."""
