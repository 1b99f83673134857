"""millrace: tabular and interaction analytics on PySpark DataFrames."""
