"""Compilers from plans to DataFrames."""
