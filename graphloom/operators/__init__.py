"""Query operators: DataFrames in, DataFrames out."""
