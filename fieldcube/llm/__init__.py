"""Training-data operators on Spark DataFrames.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame, uses only the columns it is told to use, and returns a DataFrame.
"""
