"""Operators of a training-data pipeline over the tables documents, pages, labels and embeddings."""
