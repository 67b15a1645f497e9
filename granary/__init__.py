"""Granary: a PySpark-native analytics engine for image-annotation and detection data."""
