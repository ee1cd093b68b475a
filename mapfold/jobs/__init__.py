"""Registered queries: each reads the given tables and runs one operator."""
