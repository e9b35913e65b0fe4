"""Corpus curation and accounting on PySpark: pure functions DataFrame -> DataFrame."""
