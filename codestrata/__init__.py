"""codestrata: a PySpark-native engine for source-quality analytics over text, records and change history."""

__version__ = "0.1.0"
