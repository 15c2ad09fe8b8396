"""Registered queries and their SQL twins."""
