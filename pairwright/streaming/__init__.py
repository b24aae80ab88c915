"""Decisions arriving over time, counted as they arrive."""
