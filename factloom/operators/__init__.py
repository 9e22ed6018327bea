"""Operators on the fact table."""
