"""Structured Streaming: resume, append, and the incumbent as state."""
