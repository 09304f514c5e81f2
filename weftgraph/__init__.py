"""weftgraph: a Spark-native engine for documentation graphs."""

__version__ = "0.1.0"
