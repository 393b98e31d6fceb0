"""Structured Streaming jobs over halt feeds and minute bars."""
