"""Operators for building training corpora out of documents, pages and conversations.

Nothing else in the package imports this folder.
"""
