"""Column builders: wrapping 64-bit arithmetic, money and time."""
