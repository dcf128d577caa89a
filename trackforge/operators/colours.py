"""Teams, goalkeepers and referees of a match by the colours they wear.

A rule that many players meet tells nothing about any of them, so rules are all or none. Goalkeepers and the teams'
centres depend on each other; they are a fixed point.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trackforge.operators.grouping import grouped
from trackforge.params import Pitch

UNKNOWN, KEEPER, REFEREE = -1, -2, -3


@dataclass(frozen=True)
class Colours:
    """What tells teams, goalkeepers and referees apart by colour. Distances are those of the colour space."""

    outlier: float = 2.5  # medians of the distance to a team's centre beyond which a colour is nobody's
    least_limit: float = 15.0
    kit_radius: float = 22.0  # from a goalkeeper's kit
    kit_share: float = 0.6  # of the distance to a team: clearly a goalkeeper below it
    kit_distance: float = 15.0  # beyond it the two goalkeepers' kits tell whose goalkeeper it is
    most_keepers: float = 0.30
    referee_limit: float = 20.0
    referee_share: float = 0.5
    most_referees: float = 0.10
    least_referees: int = 20
    rounds: int = 3
    start_s: float = 15.0
    zone: float = 7.0
    least_frames: int = 5


def two_means(x: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Two centres and the nearer one of each row; starts from the ends of the widest direction, so it is reproducible."""
    off = x - x.mean(0)
    _, _, axes = np.linalg.svd(off, full_matrices=False)
    side = (off @ axes[0] > 0).astype(int)
    for _ in range(rounds):
        if not 0 < side.sum() < len(side):
            break
        centres = np.stack([x[side == i].mean(0) for i in (0, 1)])
        new = distances(x, centres).argmin(1)
        if (new == side).all():
            break
        side = new
    centres = np.stack([x[side == i].mean(0) if (side == i).any() else x.mean(0) for i in (0, 1)])
    if centres[0, 0] > centres[1, 0]:  # the darker one is team 0
        centres, side = centres[::-1], 1 - side
    return centres, side


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """A row for each colour, a column for each centre."""
    return np.linalg.norm(x[:, None] - centres[None], axis=2)


def all_or_none(found: np.ndarray, most: float, among: int) -> np.ndarray:
    """found, or nothing if it has more than the share most of all."""
    return found & (found.sum() <= most * max(1, among))


def fixed_point(step: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int) -> np.ndarray:
    """What step leaves as it is, reached from start, or what it makes last."""
    for _ in range(rounds):
        start, before = step(start), start
        if (start == before).all():
            break
    return start


def referees_colour(colour: np.ndarray, p: Colours) -> tuple[np.ndarray, float]:
    """Median colour of referees and the distance up to which a colour may be theirs; none if there are too few."""
    if len(colour) < p.least_referees:
        return np.full(colour.shape[1], np.inf), 0.0
    centre = np.median(colour, axis=0)
    return centre, min(p.referee_limit, max(p.least_limit, p.outlier * float(np.median(distances(colour, centre[None])))))


def roles(colour: np.ndarray, referee: np.ndarray, kits: np.ndarray, p: Colours) -> tuple[np.ndarray, np.ndarray]:
    """For each row team 0 (darker) or 1, UNKNOWN, KEEPER or REFEREE, and the teams' centres. kits: colours of goalkeepers.

    Everything is a condition on four distances: to the nearest kit, to the referees' colour, and to either team.
    """
    player = ~referee
    n = int(player.sum())
    referees, limit = referees_colour(colour[referee], p)
    d = pd.DataFrame({"kit": distances(colour, kits).min(1) if len(kits) else np.inf, "referee": distances(colour, referees[None])[:, 0]})
    outfield = player & (d.referee > limit).to_numpy()
    like_kit = all_or_none(player & (d.kit <= p.kit_radius).to_numpy(), p.most_keepers, n)

    def centres(keepers: np.ndarray) -> np.ndarray:
        sample = outfield & ~keepers
        return two_means(colour[sample if sample.any() else player])[0]

    def clearly(keepers: np.ndarray) -> np.ndarray:
        return like_kit & (d.kit < p.kit_share * distances(colour, centres(keepers)).min(1)).to_numpy()

    keepers = all_or_none(fixed_point(clearly, like_kit, p.rounds), p.most_keepers, n)
    found = centres(keepers)
    d["team"], d["away"] = distances(colour, found).argmin(1), distances(colour, found).min(1)
    typical = d[outfield & ~keepers].groupby("team").away.median().reindex([0, 1])
    d["limit"] = np.maximum(p.outlier * typical, p.least_limit).fillna(p.least_limit).to_numpy()[d.team]
    like_referee = all_or_none((player & ~keepers & (d.referee <= limit) & (d.referee < p.referee_share * d.away)).to_numpy(), p.most_referees, n)
    return np.select([referee | like_referee, keepers, d.away <= d.limit], [REFEREE, KEEPER, d.team], UNKNOWN), found


def starting_kits(rows: pd.DataFrame, length: float, p: Colours) -> dict[tuple[int, str], np.ndarray]:
    """Colours of the players that stand outermost, near each goal, in the first seconds of each half. Rows: half, t, x, colour."""
    out = {}
    for half, of_half in rows.groupby("half"):
        early = of_half[of_half.t <= of_half.t.min() + 1000 * p.start_s]
        for side, pick, near in (("left", "idxmin", early.x < p.zone), ("right", "idxmax", early.x > length - p.zone)):
            ends = early.loc[getattr(early.groupby("t").x, pick)()] if len(early) else early
            ends = ends[near.loc[ends.index]]
            if len(ends) >= p.least_frames:
                out[half, side] = np.median(np.stack(ends.colour.to_numpy()).astype(float), axis=0)
    return out


def keepers_teams(rows: pd.DataFrame, team: np.ndarray, kits: dict[tuple[int, str], np.ndarray], length: float, p: Colours) -> np.ndarray:
    """The team of each goalkeeper among the rows (half, t, x, colour).

    A side of the pitch is defended by the team that most players there belong to when the half begins. If the kits of
    both teams' goalkeepers are known and differ enough, the nearer kit tells the team, else the side does.
    """
    early = rows.t <= rows.groupby("half").t.transform("min") + 1000 * p.start_s
    between = (rows.x - length / 2).abs().between(1, length / 2 - p.zone - 1, inclusive="neither")
    seen = rows.assign(team=team, side=np.where(rows.x < length / 2, "left", "right"))
    defends = seen[early & between & (team >= 0)].groupby(["half", "side"]).team.agg(lambda x: int(x.mode().iloc[0])).to_dict()
    worn = {t: [kit for place, kit in kits.items() if defends.get(place) == t] for t in (0, 1)}
    keepers = seen[team == KEEPER]
    if all(worn.values()):
        own = np.stack([np.median(worn[t], axis=0) for t in (0, 1)])
        if distances(own[:1], own[1:])[0, 0] > p.kit_distance:
            return distances(np.stack(keepers.colour.to_numpy()).astype(float), own).argmin(1)
    return np.array([defends.get(place, UNKNOWN) for place in zip(keepers.half, keepers.side, strict=True)], int)


def teams_by_colour(df: DataFrame, keys: list[str], p: Colours = Colours(), length: float = Pitch().length) -> DataFrame:
    """Team 0 (darker), 1, or -1 for colours far from both. Rows: id, colour (array). One group is one match's sample.

    With half, t (ms) and x as well, goalkeepers are told apart by the kits that stand near the goals when a half begins,
    and get the team of their kit or of their side. With referee (boolean), players in the referees' colour get no team,
    nor do referees.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        colour = np.stack(rows.colour.to_numpy()).astype(float)
        referee = rows.referee.fillna(False).to_numpy(bool) if "referee" in rows else np.zeros(len(rows), bool)
        kits = starting_kits(rows[~referee], length, p) if {"half", "t", "x"} <= set(rows.columns) else {}
        team, _ = roles(colour, referee, np.stack(list(kits.values())) if kits else np.zeros((0, colour.shape[1])), p)
        if (team == KEEPER).any():
            team[team == KEEPER] = keepers_teams(rows, team, kits, length, p)
        return pd.DataFrame({"id": rows.id.to_numpy(), "team": np.where(team < 0, UNKNOWN, team).astype("int32")})

    return grouped(df, keys, run, [("id", df.schema["id"].dataType), ("team", T.IntegerType())])
