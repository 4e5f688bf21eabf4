"""Moment retrieval over frames, text, speech and events as PySpark DataFrame operators."""
