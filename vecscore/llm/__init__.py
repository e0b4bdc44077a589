"""Operators for large text-corpus preparation."""
