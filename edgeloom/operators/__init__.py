"""Relational operators over the long tables. Each returns a lazy DataFrame."""
