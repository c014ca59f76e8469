"""Replay over tables: one vectorised pass per record, never per pair.

Predicates that need no replay belong before these functions; what a function
returns should be written or cached before it is filtered on and selected, as
Spark would otherwise run it once for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.board import pocket_tokens
from . import lines
from .board import Board

#: The columns that say where an event starts and how it goes on.
EVENT = {
    "fen": "string", "uci_moves_prefix": "array<string>", "uci_moves": "array<string>", "ply": "int", "board_fen": "string",
    "solution_uci": "array<string>", "pv_before": "array<string>", "bestmove_before": "string",
}

STRINGS = T.ArrayType(T.StringType())

STATS = T.StructType(
    [
        T.StructField(n, k)
        for n, k in {
            "actions": STRINGS, "drops": T.IntegerType(), "loss": T.DoubleType(), "own_captures": T.IntegerType(), "other_captures": T.IntegerType(),
            "mate_king": T.IntegerType(), "mate_square": T.IntegerType(), "capture_squares": T.ArrayType(T.IntegerType()), "checkers": STRINGS,
        }.items()
    ]
)

PLIES = T.ArrayType(
    T.StructType([T.StructField("ply", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("uci", "san", "fen")]])
)


def _records(frame: pd.DataFrame) -> Iterator[dict]:
    for row in frame.to_dict("records"):
        yield {
            k: (v.tolist() if hasattr(v, "tolist") and not isinstance(v, (int, float)) else None if isinstance(v, float) and v != v else v)
            for k, v in row.items()
        }


def event(df: DataFrame) -> Column:
    """The struct of EVENT's columns; null for those that ``df`` lacks."""
    return F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in EVENT.items()])


@F.pandas_udf(STRINGS)
def dynamic_tokens(events: pd.DataFrame) -> pd.Series:
    return pd.Series([lines.dynamic_tokens(_plied(r)) for r in _records(events)], dtype=object)


@F.pandas_udf(STRINGS)
def motif_tokens(events: pd.DataFrame) -> pd.Series:
    return pd.Series([lines.motif_tokens(_plied(r)) for r in _records(events)], dtype=object)


def _plied(rec: dict) -> dict:
    return rec | {"ply": None if rec.get("ply") is None else int(rec["ply"])}


def _board(fen: str | None) -> Board | None:
    try:
        return Board.parse(fen) if fen else None
    except ValueError:
        return None


@F.pandas_udf(T.BooleanType())
def has_move(fens: pd.Series) -> pd.Series:
    """Whether the position can be read and its game goes on."""
    boards = map(_board, fens)
    return pd.Series([b is not None and next(b.legal(), None) is not None for b in boards], dtype="bool")


@F.pandas_udf(STATS)
def line_stats(fens: pd.Series, solutions: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lines.line_stats(_board(f), list(s) if s is not None else []) for f, s in zip(fens, solutions)])


@F.pandas_udf(STRINGS)
def picture_and_march(fens: pd.Series, solutions: pd.Series) -> pd.Series:
    """mate: and km: tokens from a position and its line."""
    return pd.Series([lines.motif_tokens({"fen": f, "solution_uci": list(s) if s is not None else []}) for f, s in zip(fens, solutions)], dtype=object)


@F.pandas_udf(PLIES)
def replay_game(moves: pd.Series) -> pd.Series:
    """A game of UCI moves, ply by ply, up to the first illegal one."""
    return pd.Series([[dict(zip(("ply", "uci", "san", "fen"), p)) for p in lines.game_plies(list(m) if m is not None else [])] for m in moves], dtype=object)


PUZZLE = (
    "site string, event_id string, mate_plies int, mate_moves int, ply int, turn string, uci_moves array<string>, solution_uci array<string>,"
    " solution_san array<string>, board_fen string, fen string"
)


def mate_puzzles(games: DataFrame, last: int = 5) -> DataFrame:
    """Games (site, san_moves) that end in mate, cut before their last plies; others fall away here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for site, moves in zip(frame["site"], frame["san_moves"]):
                if moves is None or not len(moves) or not str(moves[-1]).rstrip("!?").endswith("#"):
                    continue
                cut = lines.mate_cut(lines.game_plies(list(moves), san=True), last)
                if cut:
                    rows.append(
                        {"site": site, "event_id": f"{site}_mate{last}", "mate_plies": last, "mate_moves": last // 2 + 1, "board_fen": cut["fen"].split("[")[0]} | cut
                    )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PUZZLE.split(", ")])

    return games.select("site", "san_moves").mapInPandas(run, PUZZLE)


def corpus(events: DataFrame, static: Column, white_pocket: Column, black_pocket: Column) -> DataFrame:
    """``events`` with the six token fields, as arrays, and text_all's weights as a map.

    ``static`` are the position's tokens; weights are three for whole-line and
    motif tokens, two for moves and pockets, one for the position.
    """
    rows = events.withColumn("__dyn", dynamic_tokens(event(events))).withColumn("text_motif", motif_tokens(event(events)))
    dyn, motif, pocket = F.col("__dyn"), F.col("text_motif"), pocket_tokens(white_pocket, black_pocket)
    general = F.filter(dyn, lambda t: t.startswith("dyn:") | t.startswith("sum:"))
    moves = F.filter(dyn, lambda t: t.startswith("pv:"))
    return rows.select(
        *events.columns,
        F.concat(general, motif).alias("text_dynamic_general"), moves.alias("text_dynamic_solution"), F.concat(dyn, motif).alias("text_dynamic"),
        F.concat(static, pocket).alias("text_static"), "text_motif",
        tx.weighted_bag([(general, 3), (motif, 3), (moves, 2), (pocket, 2), (static, 1)]).alias("text_all"),
    )


# --- engines


class Engine(Protocol):
    """Something that finds lines. ``close`` ends its process, if it has one."""

    def find_mate(self, fen: str) -> list[str] | None: ...

    def close(self) -> None: ...


class MateSearch:
    """Forced mates by exhaustive search: the side to move gives check with every move. No process, no settings but the depth."""

    def __init__(self, plies: int = 5):
        self.plies = plies

    def find_mate(self, fen: str) -> list[str] | None:
        return self._line(Board.parse(fen), self.plies)

    def _line(self, board: Board, plies: int) -> list[str] | None:
        """The shortest checking line that mates against every reply, with the longest defence; ties to the first move."""
        best: list[str] | None = None
        for move in board.legal():
            after = board.copy()
            after.push(move)
            if not after.is_check():
                continue
            replies = list(after.legal())
            if not replies:
                return [move.uci()]
            if plies < 3 or (best is not None and len(best) <= 3):
                continue
            longest: list[str] | None = []
            for reply in replies:
                then = after.copy()
                then.push(reply)
                line = self._line(then, plies - 2)
                if line is None:
                    longest = None
                    break
                if len(line) + 1 > len(longest):
                    longest = [reply.uci(), *line]
            if longest and (best is None or len(longest) + 1 < len(best)):
                best = [move.uci(), *longest]
        return best

    def close(self) -> None:
        pass


class UciEngine:
    """An engine behind a pipe, for clusters whose workers have one: handshake, variant, one search per position."""

    def __init__(self, binary: str, options: dict[str, object] | None = None, movetime_ms: int = 1500):
        import subprocess

        self.movetime = movetime_ms
        self.process = subprocess.Popen([binary], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        self._ask("uci", "uciok")
        for key, value in ({"UCI_Variant": "crazyhouse"} | (options or {})).items():
            self._say(f"setoption name {key} value {value}")
        self._ask("isready", "readyok")

    def _say(self, line: str) -> None:
        self.process.stdin.write(line + "\n")

    def _ask(self, line: str, until: str) -> list[str]:
        self._say(line)
        out = []
        for answer in self.process.stdout:
            out.append(answer.strip())
            if out[-1].startswith(until):
                return out
        raise RuntimeError("the engine ended")

    def analyse(self, fen: str) -> dict:
        """cp, mate and pv of the last report."""
        self._say(f"position fen {fen}")
        out: dict = {"cp": None, "mate": None, "pv": []}
        for line in self._ask(f"go movetime {self.movetime}", "bestmove"):
            words = line.split()
            if "score" in words and "pv" in words:
                at = words.index("score")
                kind, value = words[at + 1], int(words[at + 2])
                out = {"cp": value if kind == "cp" else None, "mate": value if kind == "mate" else None, "pv": words[words.index("pv") + 1 :]}
        return out

    def find_mate(self, fen: str) -> list[str] | None:
        found = self.analyse(fen)
        return found["pv"] if (found["mate"] or 0) > 0 else None

    def close(self) -> None:
        self._say("quit")
        self.process.wait(5)


def verified(puzzles: DataFrame, make: Callable[[], Engine] = MateSearch, plies: int = 5) -> DataFrame:
    """(event_id, solution_uci, solution_san, mate_moves, engine_verified) of puzzles (event_id, fen) whose engine line mates in exactly ``plies``.

    One engine per task, made anew if it fails on a position; a position on
    which it fails twice is left out.
    """
    schema = "event_id string, solution_uci array<string>, solution_san array<string>, mate_moves int, engine_verified boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        try:
            for frame in frames:
                rows = []
                for event_id, fen in zip(frame["event_id"], frame["fen"]):
                    line = None
                    for _ in range(2):
                        try:
                            line = engine.find_mate(fen)
                            break
                        except (RuntimeError, OSError):
                            engine = make()
                    found = lines.until_mate(Board.parse(fen), line or [])
                    if found and len(found) == plies:
                        rows.append((event_id, [u for u, _ in found], [s for _, s in found], len(found) // 2 + 1, True))
                yield pd.DataFrame(rows, columns=["event_id", "solution_uci", "solution_san", "mate_moves", "engine_verified"])
        finally:
            engine.close()

    return puzzles.select("event_id", "fen").mapInPandas(run, schema)
