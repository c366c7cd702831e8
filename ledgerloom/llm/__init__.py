"""Operators for training-data corpora: documents, pages and benchmark items in, decisions per row out."""
