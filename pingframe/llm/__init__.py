"""Operators of a training-data pipeline: text, conversations, vectors and web pages at corpus scale."""
