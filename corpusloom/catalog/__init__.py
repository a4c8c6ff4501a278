"""Queries over the supplied tables by area, each with the SQL that states the same."""
