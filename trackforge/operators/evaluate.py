"""Matching of found events to official minutes: largest matching, shift of clocks, explanation of goals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trackforge.operators.assignment import largest_matching
from trackforge.operators.grouping import grouped


def minute_of(t_s: float, shift_s: float) -> int:
    return int((t_s + shift_s) // 60) + 1


def match_minutes(found: list[float], official: list[int], shift_s: float, tolerance: int) -> dict[int, int]:
    """found event -> official goal, for as many as possible within tolerance minutes."""
    return largest_matching([[j for j, m in enumerate(official) if abs(minute_of(t, shift_s) - m) <= tolerance] for t in found], len(official))


def best_shift(found: list[float], official: list[int], tolerance: int = 1, most: int = 300, step: int = 5) -> tuple[int, int]:
    """Shift in seconds with the most matches, then of least size, then the smaller; and the number of matches."""
    scored = [(-len(match_minutes(found, official, s, tolerance)), abs(s), s) for s in range(-most, most + 1, step)]
    n, _, shift = min(scored)
    return shift, -n


def align_clocks(events: DataFrame, keys: list[str], tolerance: int = 1, most: int = 300, step: int = 5) -> DataFrame:
    """Per key the best shift and matches. Rows: t_s of found events, minute of official ones (the other is null)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found, official = sorted(rows.t_s.dropna()), sorted(int(m) for m in rows.minute.dropna())
        shift, n = best_shift(found, official, tolerance, most, step)
        return pd.DataFrame({"shift_s": [shift], "matched": [n], "found": [len(found)], "official": [len(official)]})

    return grouped(events, keys, run, [(c, T.IntegerType()) for c in ("shift_s", "matched", "found", "official")])


def explain_goals(events: DataFrame, keys: list[str], shift_s: float = 0, tolerance: int = 1) -> DataFrame:
    """For each official goal what explains it: a ball event, else the nearest unused formation event, else nothing.

    Rows: t_s and how ("ball" or "formation") of events, minute of official goals.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        official = sorted(int(m) for m in rows.minute.dropna())
        events_of = {h: sorted(rows.t_s[rows.how == h].dropna()) for h in ("ball", "formation")}
        by_ball = {j: events_of["ball"][i] for i, j in match_minutes(events_of["ball"], official, shift_s, tolerance).items()}
        free, out = list(events_of["formation"]), []
        for j, m in enumerate(official):
            if j in by_ball:
                out.append((m, "ball", by_ball[j]))
                continue
            near = min(free, key=lambda t: (abs(minute_of(t, shift_s) - m), t), default=None)
            if near is not None and abs(minute_of(near, shift_s) - m) <= tolerance:
                free.remove(near)
                out.append((m, "formation", near))
            else:
                out.append((m, None, None))
        return pd.DataFrame(out, columns=["minute", "explained_by", "t_s"]).astype({"t_s": float})

    return grouped(events, keys, run, [("minute", T.IntegerType()), ("explained_by", T.StringType()), ("t_s", T.DoubleType())])
