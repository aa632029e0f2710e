"""Extractors: from the text of one source file to rows of the code index."""
