"""Fitted features on streaming DataFrames."""
