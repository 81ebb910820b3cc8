"""Spark-native corpus building, retrieval, answer checking, evaluation and monitoring."""
