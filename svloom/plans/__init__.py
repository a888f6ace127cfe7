"""Queries and pipelines built from the operators."""
