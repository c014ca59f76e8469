"""Scalar helpers: clipping, ordinals, buckets, tolerant parsing, ids."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed ranges of the metadata features.
CLIPS = {"delta": (None, 10_000), "cp": (-2000, 2000), "rating": (500, 3500), "time": (30, 7200)}

# Fixed ordinals of playing speeds; anything else is 0.
SPEEDS = {"bullet": 1, "blitz": 2, "rapid": 3, "classical": 4, "correspondence": 5}


def clipped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Within bounds; null stays null."""
    out = x
    if high is not None:
        out = F.when(x > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(x < low, F.lit(low)).otherwise(out)
    return out


def ordinal(x: Column, codes: Mapping[str, int], unknown: int = 0) -> Column:
    out = F.lit(unknown)
    for name, code in codes.items():
        out = F.when(x == name, F.lit(code)).otherwise(out)
    return out


def count_bucket(n: Column) -> Column:
    """0, 1, 2 or 3plus."""
    return F.when(n >= 3, "3plus").otherwise(n.cast("string"))


def length_bucket(n: Column) -> Column:
    return F.when(n <= 3, "short").when(n <= 7, "med").otherwise("long")


def safe_int(x: Column) -> Column:
    """An integer, or null for anything that isn't one."""
    return F.trim(x.cast("string")).try_cast("int")


def average_rating(white: Column, black: Column) -> Column:
    """The floored mean if both are known and not 0."""
    known = white.isNotNull() & black.isNotNull() & (white != 0) & (black != 0)
    return F.when(known, F.floor((white + black) / 2).cast("int"))


def score_to_cp(cp: Column, mate: Column) -> Column:
    """Centipawns; a mate counts 100000 for the side that gives it."""
    return F.when(mate > 0, 100_000.0).when(mate.isNotNull(), -100_000.0).otherwise(cp.cast("double"))


def array_of(x: Column) -> Column:
    """An array from JSON text, or from words if it isn't a JSON array; none for null."""
    text = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    words = F.filter(F.split(text, r"[\s,]+"), lambda t: t != "")
    return F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), words)).otherwise(words)


def map_of(x: Column) -> Column:
    """letter -> count from JSON text, counts above 0 only; empty for null."""
    parsed = F.from_json(F.coalesce(x, F.lit("{}")), "map<string,int>")
    return F.map_filter(F.coalesce(parsed, F.create_map().cast("map<string,int>")), lambda _, n: n > 0)


def doc_id(event_id: Column, site: Column, ply: Column) -> Column:
    """The event's id, else site and ply."""
    return F.coalesce(F.when(event_id != "", event_id), F.concat_ws("_", site, ply.cast("string")))


def query_id(fen: Column) -> Column:
    return F.concat(F.lit("qfen_"), F.substring(F.sha1(fen.cast("binary")), 1, 12))


def source_site(event_id: Column) -> Column:
    """An id without its ``_mateN`` or ``_N`` end."""
    return F.regexp_replace(event_id, r"_(mate)?\d+$", "")


def ply_of(event_id: Column) -> Column:
    """The number after the last ``_``; null if it isn't one."""
    return F.element_at(F.split(event_id, "_"), -1).try_cast("int")


def is_synthetic(event_id: Column, mark: str = "syn_") -> Column:
    return event_id.startswith(mark)


def game_url(site: Column, ply: Column) -> Column:
    """``site#ply``, without what follows the game's id."""
    base = F.regexp_replace(F.regexp_replace(site, "#.*$", ""), "/$", "")
    return F.when(ply.isNotNull(), F.concat(base, F.lit("#"), ply.cast("string"))).otherwise(base)


def url_parameters(query: Column) -> Column:
    """name -> value of a URL's query string, decoded."""
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p.contains("="))
    return F.map_from_entries(
        F.transform(
            pairs, lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)), F.url_decode(F.regexp_replace(p, "^[^=]*=", "")))
        )
    )


def pocket_text(pocket: Column) -> Column:
    """``N2 P1``: sorted letters with counts; ``-`` if there are none."""
    parts = F.transform(F.array_sort(F.map_entries(F.map_filter(pocket, lambda _, n: n > 0))), lambda e: F.concat(e["key"], e["value"].cast("string")))
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("-")
