"""Readers: archives, events, hits, features, feeds, expectations, streams."""
