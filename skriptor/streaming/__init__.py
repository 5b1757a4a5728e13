"""Skriptor: streaming."""
