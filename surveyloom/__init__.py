"""Survey-response analytics on PySpark DataFrames."""
