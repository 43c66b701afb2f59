"""Graph analytics over code and documents, on Spark DataFrames."""
