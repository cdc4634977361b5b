"""Operators over versions, transactions, logs and files."""
