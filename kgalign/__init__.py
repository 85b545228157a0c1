"""Spark jobs for aligning the entities of two knowledge graphs."""
