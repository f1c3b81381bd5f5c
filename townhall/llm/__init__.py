"""Operators for building training data, each a job over the documents table."""
