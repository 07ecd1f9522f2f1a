"""Spark-native engine for metadata graphs, data lineage and training-data work."""
