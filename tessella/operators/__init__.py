"""Operators over the support-desk schema: DataFrames in, DataFrames out."""
