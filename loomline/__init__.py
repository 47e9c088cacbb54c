"""loomline: a PySpark-native engine for source-code and documentation knowledge bases."""

__version__ = "0.1.0"
