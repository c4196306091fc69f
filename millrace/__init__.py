"""Millrace: behaviour analytics and corpus preparation on PySpark DataFrames."""
