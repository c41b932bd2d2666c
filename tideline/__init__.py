"""Change-feed processing and training-data preparation on PySpark DataFrames."""
