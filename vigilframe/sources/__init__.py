"""Readers: files and collected text to typed DataFrames."""
