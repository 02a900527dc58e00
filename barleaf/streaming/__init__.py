"""Bars that arrive day by day."""
