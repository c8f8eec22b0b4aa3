"""quarry: governed-memory analytics and corpus preparation on Spark DataFrames."""
