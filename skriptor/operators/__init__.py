"""Skriptor: operators."""
