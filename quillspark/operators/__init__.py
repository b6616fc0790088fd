"""Operators on documents, chunks, postings, vectors and the catalog."""
