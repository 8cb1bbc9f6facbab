"""Planar geometry without outside libraries: values, codecs, measures, relations, overlays."""
