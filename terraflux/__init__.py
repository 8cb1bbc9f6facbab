"""Spatio-temporal analytics as DataFrame and SQL operations."""
