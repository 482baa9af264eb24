"""From patterns to plans to DataFrames."""
