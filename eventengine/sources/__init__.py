"""Sources of landed documents and extractors from them: documents in, candidate rows out."""
