"""The sources of gleaner."""
