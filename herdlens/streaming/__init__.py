"""Structured Streaming versions of bins, rolling means, bouts and tallies."""
