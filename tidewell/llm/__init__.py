"""Operators of a training-data pipeline over documents, pages, embeddings and conversations."""
