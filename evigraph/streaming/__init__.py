"""Streaming over a feed of findings."""
