"""The operators of gleaner."""
