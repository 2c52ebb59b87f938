"""Operators on time-indexed frames."""
