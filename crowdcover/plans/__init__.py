"""Queries over the test tables: each operator at work, next to the SQL that should agree."""
