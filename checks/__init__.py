"""Registered queries, each with the SQL that states the same result."""
