"""Operators for building training data: private data, page text, quality, copies, mixing, archives."""
