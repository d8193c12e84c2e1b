"""Readers: a path and an optional fragment become a DataFrame."""
