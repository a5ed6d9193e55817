"""Scalar functions: hashing, contract data, encodings."""
