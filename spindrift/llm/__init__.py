"""Training-data operators: each module is one operator over Spark DataFrames."""
