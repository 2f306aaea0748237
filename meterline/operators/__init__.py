"""Operators over stacked meter timelines."""
