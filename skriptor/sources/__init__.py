"""Skriptor: sources."""
