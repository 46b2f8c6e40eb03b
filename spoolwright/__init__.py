"""spoolwright: a PySpark-native engine for keyed, append-only log records."""

__version__ = "0.1.0"
