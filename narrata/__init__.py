"""Grounded-brief analytics on Spark: every operator takes and returns DataFrames or Columns."""
