"""Column expressions: text, URLs, HTML."""
