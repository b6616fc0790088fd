"""Document ingestion, chunking and hybrid retrieval as PySpark DataFrame plans."""
