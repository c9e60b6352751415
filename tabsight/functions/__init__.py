"""Column-level helpers: type classes, corrected moments, special functions."""
