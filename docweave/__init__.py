"""Spark jobs that turn collections of documentation into governed, queryable knowledge."""
