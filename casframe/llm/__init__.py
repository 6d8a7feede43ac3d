"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Operators take and return
DataFrames; texts reach Python workers as UTF-8 bytes in Arrow batches.
"""
