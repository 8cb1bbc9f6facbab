"""Scalar functions: st_* over WKB columns, and native forms over plain numbers."""
