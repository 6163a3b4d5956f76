"""Transforms of pose, animal, pair and bout tables."""
