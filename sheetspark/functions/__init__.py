"""Column functions: addresses and value types."""
