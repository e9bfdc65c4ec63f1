"""Analytic operators. Each takes DataFrames + parameters, returns a DataFrame."""
