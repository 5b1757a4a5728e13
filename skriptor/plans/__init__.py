"""Skriptor: plans."""
