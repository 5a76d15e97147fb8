"""Entity resolution and record linkage on Spark DataFrames."""
