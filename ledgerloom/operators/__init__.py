"""Relational operators over block-structured tables."""
