"""Skriptor: functions."""
