"""heronlake: fraud scoring and vector search on Spark DataFrames."""
