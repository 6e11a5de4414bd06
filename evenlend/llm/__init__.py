"""Operators that prepare text corpora for model training, each a function from DataFrames to DataFrames."""
