"""Operators for training-data corpora (documents, web pages, embeddings).

Each operator is a ``DataFrame -> DataFrame`` function in its own module;
``queries`` binds them to the given tables. Nothing else in the library
imports this subpackage.
"""
