"""Analyses as functions from DataFrames to a DataFrame."""
