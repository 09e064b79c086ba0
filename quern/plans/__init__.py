"""Registered queries and the SQL dialect."""
