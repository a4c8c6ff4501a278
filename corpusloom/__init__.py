"""corpusloom: a PySpark-native analytics engine for document corpora and concept graphs."""

__version__ = "0.1.0"
