"""Operators for building training text: filtering, de-duplication, scoring and encoding."""
