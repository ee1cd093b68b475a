"""Operators for large training-text corpora; nothing else in mapfold imports them."""
