"""Recommendation analytics as Spark jobs."""
