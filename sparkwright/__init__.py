"""sparkwright: a PySpark-native analytics engine for labelled records, scores, vectors and event sequences."""

__version__ = "0.1.0"
