"""Pitch-event analytics on Spark: DataFrame in, DataFrame out."""
