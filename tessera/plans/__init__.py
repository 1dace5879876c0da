"""Composite plans and the registered queries with their SQL twins."""
