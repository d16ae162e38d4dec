"""Queries over the given tables, one for each operator of the inventory, and their SQL."""
