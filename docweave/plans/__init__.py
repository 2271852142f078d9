"""End-to-end jobs, and the queries that apply the operators to the given tables."""
