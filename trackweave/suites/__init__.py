"""Registered queries: each suite module pairs a Spark query with the SQL that checks it."""
