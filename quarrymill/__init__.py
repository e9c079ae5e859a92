"""quarrymill: large-scale data mining operators on Spark DataFrames."""
