"""Readers of source text, and positions in it."""
