"""The library run on the given tables, each query with an SQL statement of the same result."""
