"""Workflow units: their plan as driver-side data, compiled to Columns and DataFrames."""
