"""Column expressions: typing, hashing, bands, distances. All built-in functions, no UDF."""
