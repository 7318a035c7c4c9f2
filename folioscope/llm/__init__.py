"""Operators for training-data preparation over tables of documents, pages and vectors."""
