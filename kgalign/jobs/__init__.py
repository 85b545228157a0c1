"""Queries over the star-schema tables, seen as a knowledge graph."""
