"""Operators over collections of objects."""
