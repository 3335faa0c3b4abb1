"""barloom: market-series analytics and corpus preparation as Spark DataFrames."""
