"""Operators: each takes the tables and returns one DataFrame for all keys at once."""
