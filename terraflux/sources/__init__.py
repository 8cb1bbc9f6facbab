"""Readers, converters, partitioned storage and exports."""
