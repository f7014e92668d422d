"""A Spark-native engine that consolidates, clusters and annotates genomic interval models."""

__version__ = "0.2.0"
