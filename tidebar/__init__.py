"""tidebar: market-bar analytics on Spark DataFrames."""
