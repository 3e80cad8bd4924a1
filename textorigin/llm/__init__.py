"""Operators for preparing training text, their queries and their SQL. Nothing else in the package imports this folder."""
