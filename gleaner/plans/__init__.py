"""Queries over the driver's tables: name -> (function, SQL or None)."""

from __future__ import annotations

from . import boards, evaluation, learning, pair_features, puzzles, records, relational, retrieval, similarity

MODULES = (retrieval, similarity, evaluation, relational, boards, learning, puzzles, records, pair_features)


def catalogue() -> dict:
    out: dict = {}
    for module in MODULES:
        out |= module.QUERIES
    return out
