"""Where documents, judgements and index versions are read from and written to."""
