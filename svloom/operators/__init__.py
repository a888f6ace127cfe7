"""Relational kernels of name resolution and checking, as DataFrame transforms."""
