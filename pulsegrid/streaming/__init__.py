"""Operators on unbounded event streams."""
