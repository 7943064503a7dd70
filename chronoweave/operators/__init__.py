"""Operators on evolving graphs."""
