"""Sequence and text analytics as Spark jobs."""
