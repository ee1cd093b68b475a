"""Column functions: no shuffle, no Python on the data path."""
