"""Readers and writers of pose data and results."""
