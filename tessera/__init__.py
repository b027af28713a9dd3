"""Sparse, versioned wide-column tables on Spark DataFrames."""
