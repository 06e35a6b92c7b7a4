"""Tidemark: time-series, quality, upsert and retrieval analytics as Spark DataFrame plans."""
