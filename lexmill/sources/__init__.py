"""Readers and writers of the formats of retrieval experiments."""
