"""Relational building blocks.  Each takes and returns DataFrames and stays lazy."""
