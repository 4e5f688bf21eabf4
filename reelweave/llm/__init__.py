"""Operators of a training-data pipeline: ten stages over documents, embeddings and pages."""
