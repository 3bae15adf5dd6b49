"""Search plans that combine operators, and the catalogue of queries."""
