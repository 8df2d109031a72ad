"""Spark-native engine for document collections: ingest, structure, index, search, evaluate."""
