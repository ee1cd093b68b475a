"""Readers and writers for feature files and tile archives."""
