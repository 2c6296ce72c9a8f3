"""Graph and text operators, each from DataFrames to a DataFrame."""
