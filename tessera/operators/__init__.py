"""Transformations of cell DataFrames."""
