"""Column functions: money, id arithmetic and deterministic draws."""
