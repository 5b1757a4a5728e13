"""Operators for large-language-model training data."""
