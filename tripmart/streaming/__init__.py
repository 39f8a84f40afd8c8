"""Structured Streaming jobs. Every sink can be replayed: a batch writes under its own number."""
