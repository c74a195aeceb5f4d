"""A PySpark-native engine for document retrieval analytics."""

__version__ = "0.1.0"
