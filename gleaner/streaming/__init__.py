"""The streaming of gleaner."""
