"""Reading and writing graph tables."""
