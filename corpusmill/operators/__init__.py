"""Operators on tables: DataFrame in, DataFrame out."""
