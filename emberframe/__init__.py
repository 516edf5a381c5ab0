"""emberframe: event reconstruction and evidence tables on Spark DataFrames."""
