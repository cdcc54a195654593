"""Spark jobs for rain validation, trends, land cover and pixel tables."""
