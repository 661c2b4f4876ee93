"""tidegrid: a PySpark-native engine for panel data, dated membership and rolling-window analytics.

Everything is a function from DataFrames to a DataFrame; nothing runs until the caller acts on the result.
"""
