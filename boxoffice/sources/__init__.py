"""Reading and writing the marketplace tables."""
