"""Structured Streaming jobs keeping the index current (J-3, J-4)."""
