"""Vocabularies and column expressions."""
