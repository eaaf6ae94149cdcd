"""Streams of verdicts and events."""
