"""Scalar helpers: bytes, hashes, encodings."""
