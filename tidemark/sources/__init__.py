"""Sources and sinks: files, configuration, extraction, embeddings and versioned tables."""
