"""Queries over the star-schema test tables, and their SQL."""
