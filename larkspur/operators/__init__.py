"""Data-engineering operations as functions from DataFrames to DataFrames."""
