"""Queries over the test tables, with the SQL that gives the same answer."""
