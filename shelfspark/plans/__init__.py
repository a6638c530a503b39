"""Composite jobs and the fixture bindings."""
