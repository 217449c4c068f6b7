"""loamgraph: a PySpark-native linked-data and track analytics engine."""

__version__ = "0.1.0"
