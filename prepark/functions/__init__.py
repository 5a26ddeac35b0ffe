"""Column-level helpers: type kinds, missing values, order keys, fixed patterns, vectors."""
