"""The statement language and its translation to DataFrames."""
