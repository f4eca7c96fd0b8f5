"""Document retrieval, answering and evaluation on Spark DataFrames."""
