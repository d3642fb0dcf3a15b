"""A text-corpus and trajectory analytics library on Spark DataFrames."""
