"""Structured Streaming over the commit log."""
