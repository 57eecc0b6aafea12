"""Operators over strings and pairs of strings."""
