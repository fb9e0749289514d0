"""Operators for building training corpora (text documents and web pages) on Spark."""
