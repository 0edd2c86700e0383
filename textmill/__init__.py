"""A text-corpus analytics engine on Spark DataFrames."""
