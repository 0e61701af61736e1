"""Spark-native analytics for retrieval corpora: ingestion, chunking, indexing, search, evidence and evaluation."""
