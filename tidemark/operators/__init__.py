"""Operators: retrieval, indexing, intake, deletion, jobs, audit and access as DataFrame plans."""
