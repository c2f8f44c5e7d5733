"""Set-based operators: DataFrames in, DataFrames out."""
