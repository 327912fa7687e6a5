"""tillwise: retail analytics as lazy PySpark DataFrame jobs.

Every operator is a plain function from DataFrames to a DataFrame. Reference
dates are arguments (never the clock), so a job can be re-run and compared.
"""
