"""DataFrame operators: DataFrames in, one DataFrame out."""
