"""Whole analyses as lazily built plans."""
