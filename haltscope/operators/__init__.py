"""DataFrame operators. Each takes and returns DataFrames and stays lazy."""
