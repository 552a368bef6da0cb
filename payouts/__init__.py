"""Sales-commission settlement on Spark DataFrames."""
