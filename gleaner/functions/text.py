"""Tokens, their families, and bags of them."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Families in the order that feature columns take.
STATIC_FAMILIES = ("placement", "relation", "motif", "pocket")
DYNAMIC_FAMILIES = ("pv", "dyn", "sum", "mate", "km")
FAMILIES = STATIC_FAMILIES + DYNAMIC_FAMILIES
SERVE_FAMILIES = ("pv", "dyn", "sum", "pocket", "placement", "relation", "motif")

PLACEMENT = "^[wbWB][pnbrqkPNBRQK]@"


def whitespace_tokens(text: Column) -> Column:
    """Runs of non-blank characters, as they are; none for null or blank text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def family(token: Column) -> Column:
    """The family of nine that a token's prefix or shape names; null for an empty token."""
    out = F.when(F.coalesce(token, F.lit("")) == "", F.lit(None).cast("string"))
    for prefix in ("mate", "km", "pv", "dyn", "sum"):
        out = out.when(token.startswith(f"{prefix}:"), F.lit(prefix))
    return (
        out.when(token.contains("pocket:"), F.lit("pocket"))
        .when(token.rlike(PLACEMENT), F.lit("placement"))
        .when(token.rlike("[<>=]"), F.lit("relation"))
        .otherwise(F.lit("motif"))
    )


def serve_family(token: Column) -> Column:
    """The family of seven that queries weight by: any ``@`` is a placement; mate and march tokens are motifs."""
    out = F.when(token.startswith("pv:"), F.lit("pv"))
    for prefix in ("dyn", "sum"):
        out = out.when(token.startswith(f"{prefix}:"), F.lit(prefix))
    return (
        out.when(token.contains("pocket:"), F.lit("pocket"))
        .when(token.contains("@"), F.lit("placement"))
        .when(token.rlike("[<>=]"), F.lit("relation"))
        .otherwise(F.lit("motif"))
    )


def of_family(tokens: Column, name: str) -> Column:
    """The distinct tokens of one family."""
    return F.array_distinct(F.filter(tokens, lambda t: family(t) == name))


def bag(tokens: Column) -> Column:
    """token -> count. Distinct tokens times tokens: for short lists; long ones are exploded and grouped."""
    return F.map_from_entries(
        F.transform(F.array_distinct(tokens), lambda t: F.struct(t, F.size(F.filter(tokens, lambda x: x == t))))
    )


def weighted_bag(parts: list[tuple[Column, int]]) -> Column:
    """token -> summed weight over (tokens, weight): what repeating tokens in a text amounts to."""
    def times(tokens: Column, weight: int) -> Column:
        return F.transform_values(bag(tokens), lambda _, n: n * weight)

    bags = [times(t, w) for t, w in parts]
    out = bags[0]
    for more in bags[1:]:
        out = F.map_zip_with(out, more, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return out


def by_family_weight(token: Column, weights: Mapping[str, float], default: float = 1.0, of: Callable[[Column], Column] = serve_family) -> Column:
    """The weight of the token's family, which ``of`` names."""
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(of(token) == name, F.lit(float(w))).otherwise(out)
    return out


def suffixes(tokens: Column, *prefixes: str) -> Column:
    """What follows a prefix, of the tokens that start with one, in upper case and in order."""
    def after(prefix: str) -> Column:
        own = F.filter(tokens, lambda t: t.startswith(prefix))
        return F.transform(own, lambda t: F.upper(F.substring(t, len(prefix) + 1, 10_000)))

    return F.concat(*[after(p) for p in prefixes])


def has_prefix(tokens: Column, *prefixes: str) -> Column:
    """Whether a token starts with one of ``prefixes``."""
    return F.exists(tokens, lambda t: functools.reduce(lambda a, b: a | b, [t.startswith(p) for p in prefixes]))


def repaired(text: Column) -> Column:
    """Text whose tokens were split into letters by mistake, joined: mean token length of at most 1.5."""
    tokens = whitespace_tokens(text)
    total = F.aggregate(tokens, F.lit(0), lambda n, t: n + F.length(t))
    return F.when((F.size(tokens) > 0) & (total <= 1.5 * F.size(tokens)), F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)
