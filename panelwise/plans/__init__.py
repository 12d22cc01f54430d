"""Compositions of operators: full pipeline, reporting views, stand-in data."""
