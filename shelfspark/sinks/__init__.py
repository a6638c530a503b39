"""Exports and keyed replacement."""
