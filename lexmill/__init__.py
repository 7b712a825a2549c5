"""Corpus-wide jobs over legal text on Spark: every operator takes DataFrames and returns DataFrames."""
