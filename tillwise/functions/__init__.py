"""Column builders; every one is made of built-in functions."""
