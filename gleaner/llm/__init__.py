"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it; ``queries.py`` lists what the
driver runs.
"""
