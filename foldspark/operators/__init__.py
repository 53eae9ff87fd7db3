"""Event-log operators: every function takes and returns DataFrames."""
