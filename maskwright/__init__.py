"""maskwright: sensitive-text analytics over document tables, on Spark DataFrames."""
