"""Quillon: a PySpark-native engine for editorial text analytics, knowledge
indexing and audit, expressed with the DataFrame, SQL and window APIs."""

__version__ = "0.1.0"
