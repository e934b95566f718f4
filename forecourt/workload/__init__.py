"""The operators run over the given tables, each next to the same query in SQL."""
