"""millrace: a PySpark-native engine that curates and analyses training corpora."""

__version__ = "0.1.0"
