"""Readers that give annotation files and tables as DataFrames."""
