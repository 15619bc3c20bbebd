"""Timeline alignment and training-data operators expressed as Spark DataFrames."""
