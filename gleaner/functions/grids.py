"""Grids of 3x3 cells, alike under quarter turns and mirrors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _turned(cells: tuple[int, ...]) -> tuple[int, ...]:
    """A quarter turn: the new row r, column c was row 2 - c, column r."""
    return tuple(cells[3 * (2 - c) + r] for r in range(3) for c in range(3))


def _mirrored(cells: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(cells[3 * r + 2 - c] for r in range(3) for c in range(3))


def _symmetries() -> list[tuple[int, ...]]:
    out, now = [], tuple(range(9))
    for _ in range(4):
        out += [now, _mirrored(now)]
        now = _turned(now)
    return out


#: The eight arrangements of nine cells, as positions in the original.
SYMMETRIES = _symmetries()


def least_form(cells: str) -> str:
    """The least of the eight forms, rows joined by ``/``."""
    return min("/".join("".join(cells[k] for k in s[r : r + 3]) for r in (0, 3, 6)) for s in SYMMETRIES)


def canonical(cells: Column) -> Column:
    """The same of a column of nine characters."""
    def form(s: tuple[int, ...]) -> Column:
        rows = [F.concat(*[F.substring(cells, k + 1, 1) for k in s[r : r + 3]]) for r in (0, 3, 6)]
        return F.concat_ws("/", *rows)

    return F.least(*[form(s) for s in SYMMETRIES])
