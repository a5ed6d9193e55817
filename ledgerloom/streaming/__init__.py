"""Ordered streams with a finality floor and forks."""
