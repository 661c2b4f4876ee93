"""Queries built from the operators, with the SQL they are held against."""
