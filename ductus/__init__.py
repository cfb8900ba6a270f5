"""Cleaning, spelling and evaluating lines of text, and training corpora, on Spark DataFrames."""
