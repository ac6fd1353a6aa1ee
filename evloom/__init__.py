"""Spark-first evidence retrieval and evaluation analytics."""
