"""Operators on event series: DataFrame in, DataFrame out."""
