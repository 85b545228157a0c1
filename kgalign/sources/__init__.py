"""Readers and writers of triples, links, texts and vectors."""
