"""Operators on tables of observations, each a function from DataFrames and column names to a DataFrame."""
