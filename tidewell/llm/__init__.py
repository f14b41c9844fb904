"""Operators for building training corpora. Nothing outside this folder imports it."""
