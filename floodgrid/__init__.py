"""Spark jobs for gridded flood and hydrology data."""
