"""provspark: a PySpark-native engine for code provenance in compiled binaries."""

__version__ = "0.1.0"
