"""Readers of source trees, artifacts and driver tables."""
