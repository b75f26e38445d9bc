"""The analytics operators: functions from DataFrames to DataFrames."""
