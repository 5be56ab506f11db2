"""loomgraph: a Spark-native engine for typed property graphs, code search and corpus preparation."""

__version__ = "0.1.0"
