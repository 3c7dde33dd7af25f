"""Tidemark: document intake, indexing and hybrid retrieval expressed as Spark plans."""
