"""Retrieval, ranking, lifecycle and history operators on DataFrames."""
