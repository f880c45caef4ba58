"""Operators: functions from DataFrames to DataFrames, over generic column names."""
