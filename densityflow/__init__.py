"""densityflow: score estimation and data-pipeline operators as Spark DataFrames."""
