"""Operators of a training-data pipeline: ten jobs over documents, embeddings and pages, and their queries."""
