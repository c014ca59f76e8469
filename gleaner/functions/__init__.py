"""The functions of gleaner."""
