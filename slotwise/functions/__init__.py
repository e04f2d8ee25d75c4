"""Column expressions: digits, bit sets, ranks."""
