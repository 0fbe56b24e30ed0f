"""Scholium: textbook knowledge processing on PySpark (DataFrame in, DataFrame out)."""
