"""Fleet-scale side-scan sonar survey analytics on Spark DataFrames."""
