"""Event studies on minute-bar time series, written with Spark DataFrames."""
