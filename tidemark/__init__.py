"""Spark-native document retrieval, compliance analytics and corpus preparation."""
