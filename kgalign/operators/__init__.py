"""Operators on DataFrames of triples, links, texts and vectors."""
