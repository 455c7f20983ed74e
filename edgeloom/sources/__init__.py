"""Readers and writers of models and tables."""
