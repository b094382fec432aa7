"""Document intelligence, quality evidence and training-data preparation on Spark DataFrames."""
