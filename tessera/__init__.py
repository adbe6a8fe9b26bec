"""Spark-first vector retrieval and corpus analytics."""
