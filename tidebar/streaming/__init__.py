"""Continuous forms of bars, sessions and indicators on Structured Streaming."""
