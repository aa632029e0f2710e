"""Scalar and table-valued functions over columns or single source files."""
