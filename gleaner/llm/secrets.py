"""Secret scans in SQL functions alone.

Three fixed patterns give the base spans. On top of them, a window slides
over candidate strings of each character class; its Shannon entropy follows
from counts kept up to date one character in, one character out. Windows over
the class's threshold make a span unless the candidate is on the allow-list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# A maximal run is a match of 32 or more exactly if it is that long, so that
# the bound in the pattern drops what the contract drops; the same holds of
# ACCESS, whose matches end only where a run ends.
HEX = r"[0-9a-f]{32,}"
ACCESS_LONG = r"AKIA[A-Z0-9]{12,}"

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
BASE_KINDS = 3


@dataclass(frozen=True)
class CharClass:
    """A candidate is a run of ``alphabet`` as long as the window or longer."""

    kind: str
    alphabet: str
    threshold: float
    must: tuple[str, ...]


#: Windows of this many characters; 20 of them hold 4.32 bits at most.
WINDOW = 20

CLASSES = (
    CharClass("entropy_hex", "[0-9a-fA-F]", 2.9, ("[0-9]", "[a-fA-F]")),
    CharClass("entropy_base64", "[A-Za-z0-9+/_=-]", 3.75, ("[0-9]", "[a-z]", "[A-Z]")),
)

#: Candidates matching one of these whole are no secrets: UUIDs, dates with
#: times, words joined by hyphens, underscores or slashes, names with a number.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9-]+Z?$",
    r"^/?([A-Z]?[a-z]+[0-9]{0,4}[-_/=+]+)*[A-Z]?[a-z]+[0-9]{0,4}$",
)


def _possessive(pattern: str) -> str:
    """A repeated group that gives nothing back: Java's matcher recurses once for every repetition that it may undo."""
    return pattern.replace(")*", ")*+")


def _empty() -> Column:
    return F.expr("cast(array() as array<struct<start:int,rank:int,stop:int>>)")


#: Spans that are appended one by one; full parts are appended to the parts.
PART = 256

SPAN = "struct<start:int,rank:int,stop:int>"


def _list() -> list[Column]:
    """Fields of a state for a list that grows by appending, in less than quadratic time."""
    return [F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("full"), F.expr(f"cast(array() as array<{SPAN}>)").alias("new")]


def _appended(s: Column, span: Column, when: Column) -> list[Column]:
    """The list of state ``s``, with ``span`` where ``when`` holds."""
    over = F.size(s["new"]) >= PART
    return [
        F.when(when & over, F.concat(s["full"], F.array(s["new"]))).otherwise(s["full"]).alias("full"),
        F.when(when & over, F.array(span)).when(when, F.concat(s["new"], F.array(span))).otherwise(s["new"]).alias("new"),
    ]


def _all(s: Column) -> Column:
    return F.concat(F.flatten(s["full"]), s["new"])


def _let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _span(start: Column, rank: int, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), stop.cast("int").alias("stop"))


def _spans(text: Column, pattern: str, kind: str, group: int | None = None, least: int = 0) -> Column:
    """The matches as (start, rank, stop) in code points; ``group`` must have ``least`` characters."""
    zipped = [F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))]
    if group is not None:
        zipped.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["0"])
        stop = start + F.coalesce(F.length(x["1"]), F.lit(0))
        good = x["1"].isNotNull() if group is None else F.coalesce(F.length(x["2"]) >= least, F.lit(False))
        return F.struct(stop.alias("at"), *_appended(s, _span(start, KINDS.index(kind), stop), good))

    found = F.aggregate(F.arrays_zip(*zipped), F.struct(F.lit(0).alias("at"), *_list()), step, _all)
    return F.when(text.rlike(pattern), found).otherwise(_empty())


def _xlog2(k: Column) -> Column:
    return F.when(k > 1, k * F.log2(k)).otherwise(F.lit(0.0))


#: Characters of a candidate that are taken apart at once.
STRETCH = 4096

#: The counts of a window's characters: for each ASCII code a letter, ``a`` for none.
NO_COUNTS = "a" * 128


def _count(counts: Column, c: Column) -> Column:
    return F.ascii(F.substring(counts, F.ascii(c) + 1, F.lit(1))) - 97


def _counted(counts: Column, c: Column, by: int) -> Column:
    return F.overlay(counts, F.char(_count(counts, c) + 97 + by), F.ascii(c) + 1, F.lit(1))


def windows_over(candidate: Column, threshold: float, window: int = WINDOW, rank: int = 0) -> Column:
    """Merged (start, rank, stop) of the windows of ``candidate``, which is ASCII, with that entropy.

    The state holds a count for every character and the sum of k*log2(k) over
    the counts k. A character that enters or leaves changes one count, hence
    one term. The entropy is log2(window) - sum / window. Windows that touch
    are one span, which stays open (``a`` to ``b``) until one doesn't.
    """
    bits = math.log2(window)
    # What changes with every character stands by itself: a value worked out by ``_let`` is copied, and lists must not be.
    scan = F.struct(
        F.lit("").alias("win"), F.lit(NO_COUNTS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("a"), F.lit(-1).alias("b"),
        F.lit(False).alias("shut"), F.lit(-1).alias("from"), F.lit(-1).alias("to"),
    )

    def left(w: Column) -> Column:
        """Without the first character of a full window."""
        first, full = F.substring(w["win"], 1, 1), F.length(w["win"]) >= window
        had = _count(w["counts"], first)
        return F.struct(
            F.when(full, F.substring(w["win"], 2, window)).otherwise(w["win"]).alias("win"),
            F.when(full, _counted(w["counts"], first, -1)).otherwise(w["counts"]).alias("counts"),
            F.when(full, w["sum"] - _xlog2(had) + _xlog2(had - 1)).otherwise(w["sum"]).alias("sum"),
        )

    def entered(n: Column, c: Column) -> Column:
        has = _count(n["counts"], c)
        return F.struct(
            F.concat(n["win"], c).alias("win"), _counted(n["counts"], c, 1).alias("counts"), (n["sum"] - _xlog2(has) + _xlog2(has + 1)).alias("sum")
        )

    def step(s: Column, c: Column) -> Column:
        w = s["w"]

        def then(n: Column) -> Column:
            stop = w["at"] + 1
            over = (F.length(n["win"]) == window) & (F.lit(bits) - n["sum"] / window >= threshold - 1e-9)
            start = stop - window
            shut = over & (w["b"] >= 0) & (w["b"] < start)
            return F.struct(
                n["win"].alias("win"), n["counts"].alias("counts"), n["sum"].alias("sum"), stop.alias("at"),
                F.when(shut | over & (w["b"] < 0), start).otherwise(w["a"]).alias("a"), F.when(over, stop).otherwise(w["b"]).alias("b"),
                shut.alias("shut"), w["a"].alias("from"), w["b"].alias("to"),
            )

        following = _let(left(w), lambda n: _let(entered(n, c), then))
        return F.struct(following.alias("w"), *_appended(s, _span(w["from"], rank, w["to"]), w["shut"]))

    def stretch(s: Column, part: Column) -> Column:
        return F.aggregate(F.filter(F.split(part, ""), lambda c: c != ""), s, step)

    def finish(s: Column) -> Column:
        w = s["w"]
        shut = F.when(w["shut"], F.array(_span(w["from"], rank, w["to"]))).otherwise(_empty())
        return F.concat(_all(s), shut, F.when(w["b"] >= 0, F.array(_span(w["a"], rank, w["b"]))).otherwise(_empty()))

    state = F.struct(scan.alias("w"), *_list())
    parts = F.regexp_extract_all(candidate, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    return F.aggregate(parts, state, stretch, finish)


def _entropy_spans(text: Column, cls: CharClass, window: int = WINDOW) -> Column:
    pattern = f"{cls.alphabet}{{{window},}}"
    rank = KINDS.index(cls.kind)
    state = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["0"])
        hit = F.coalesce(x["1"], F.lit(""))
        good = F.length(hit) > 0
        for need in cls.must:
            good = good & hit.rlike(need)
        for allowed in ALLOWED:
            good = good & ~hit.rlike(_possessive(allowed))
        found = F.transform(windows_over(hit, cls.threshold, window, rank), lambda w: _span(start + w["start"], rank, start + w["stop"]))
        return F.struct(
            (start + F.length(hit)).alias("at"), F.when(good, F.concat(s["out"], F.array(found))).otherwise(s["out"]).alias("out")
        )

    zipped = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(text.rlike(pattern), F.aggregate(zipped, state, step, lambda s: F.flatten(s["out"]))).otherwise(_empty())


def _apart(spans: Column) -> Column:
    """Of sorted ``spans`` the base ones, and those that touch none of them: a sweep from each side."""
    own = lambda x: x["rank"] < F.lit(BASE_KINDS)
    zero = lambda edge: F.struct(F.lit(edge).alias("edge"), *_list())

    def ahead(s: Column, x: Column) -> Column:
        return F.struct(F.when(own(x), F.greatest(s["edge"], x["stop"])).otherwise(s["edge"]).alias("edge"), *_appended(s, x, own(x) | (s["edge"] <= x["start"])))

    def back(s: Column, x: Column) -> Column:
        return F.struct(F.when(own(x), x["start"]).otherwise(s["edge"]).alias("edge"), *_appended(s, x, own(x) | (s["edge"] >= x["stop"])))

    return F.reverse(F.aggregate(F.reverse(F.aggregate(spans, zero(-1), ahead, _all)), zero((1 << 31) - 1), back, _all))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
        ),
        ",",
    )


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    Added spans that touch a base span are left out, as it is reported
    already. Nulls: a null text counts as empty and has no spans; a null id is
    kept. Repeated rows each get their row; extra columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    text = F.col("__text")
    rows = rows.select(
        "doc_id",
        _spans(text, ASSIGN, "assign", 2, 8).alias("__assign"),
        _spans(text, ACCESS_LONG, "access").alias("__access"),
        _spans(text, HEX, "hex").alias("__hex"),
        F.concat(*[_entropy_spans(text, c) for c in CLASSES]).alias("__more"),
    )
    base = F.array_sort(F.concat("__assign", "__access", "__hex"))
    rows = rows.select("*", base.alias("__base"))
    added = F.when(F.size("__more") > 0, _apart(F.array_sort(F.concat("__base", "__more")))).otherwise(F.col("__base"))
    return rows.select(
        "doc_id",
        F.size("__assign").cast("long").alias("n_assign"),
        F.size("__access").cast("long").alias("n_access"),
        F.size("__hex").cast("long").alias("n_hex"),
        F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"),
        _joined(added).alias("spans"),
    )
