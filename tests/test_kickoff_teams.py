"""Teams from kick-offs against plain versions of the rules, match by match."""

import numpy as np
import pytest

from trackforge.operators import kickoff_teams as kt
from trackforge.params import Pitch

P, L = kt.Kits(least_limit=6.0, fade_s=60.0, step_s=20.0, least_pseudo=20, most_pseudo=200), Pitch().length
SCHEMA = "match_id string, half int, t long, x double, keeper boolean, who int, colour array<double>, descriptor array<double>"
EVENTS = "match_id string, half int, event long, by_ball boolean, t0 long, t1 long"


def made_up(match, seed, mixed=(), wrong=(), players=5, drift=30.0, halves=2, ends_change=True):
    """A match of two halves of 200 s with a kick-off every 50 s; kits get lighter as time goes by.

    mixed: kick-offs at which both teams stand everywhere; wrong: formations at which the teams stand on the other sides.
    """
    rng = np.random.default_rng(seed)
    direction = rng.normal(0, 1, 4)
    rows, events, team_of = [], [], {}
    for half in range(1, halves + 1):
        start = 300_000 * (half - 1)
        kicks = [start + 50_000 * k for k in range(4)]
        for k, event in enumerate(kicks):
            events.append((match, half, event, k % 2 == 0 and (half, k) not in wrong, event, event + 2000))
        for t in range(start, start + 200_000, 500):
            near = next((k for k, e in enumerate(kicks) if e <= t <= e + 2000), None)
            if near is None and t % 5000:
                continue
            for n in range(2 * players + 2):
                team, keeper = n % 2, n >= 2 * players
                left = (team == 0) == (half == 1 or not ends_change)
                if (half, near) in wrong:
                    left = not left
                x = rng.uniform(9, 26) if left else rng.uniform(30, 47)
                if near is None or (half, near) in mixed:
                    x = rng.uniform(9, 47)
                if keeper:
                    x = 3.0 if left else 53.0
                kit = np.array([90.0, 140.0, 120.0]) if team == 0 else np.array([40.0, 120.0, 128.0])
                kit = kit + drift * t / 500_000 + rng.normal(0, 2, 3) + (60 if rng.random() < 0.02 else 0)
                look = direction * (1.3 if team else -1.3) + rng.normal(0, 1, 4)
                if rng.random() < 0.03:
                    look = None
                team_of[match, t, n] = team
                rows.append((match, half, t, float(x), keeper, n, kit.tolist(), None if look is None else look.tolist()))
    return rows, events, team_of


def plain_examples(rows, events, p):
    out = []
    for match, half, event, ball, t0, t1 in events:
        times = sorted({r[2] for r in rows if r[:2] == (match, half) and t0 <= r[2] <= t1})
        n = min(p.frames, len(times))
        times = {times[int(k * (len(times) - 1) / max(1, p.frames - 1)) if len(times) > p.frames else k] for k in range(n)}
        mine = [(0 if r[3] < L / 2 else 1, r) for r in rows if r[:2] == (match, half) and r[2] in times and not r[4] and abs(r[3] - L / 2) >= p.centre and p.zone <= r[3] <= L - p.zone]
        out.append((half, event, ball, mine))
    return out


def away(a, b):
    return float(np.linalg.norm(np.asarray(a) - np.asarray(b)))


def plain_kits(rows, events, p):
    """decisions, left team of each half, and team of each row of one match."""
    decisions, kept = {}, []
    for half in sorted({e[1] for e in events}):
        first = None
        for _, event, ball, mine in sorted((e for e in plain_examples(rows, events, p) if e[0] == half), key=lambda e: (not e[2], e[1])):
            sides = [[r[6] for s, r in mine if s == k] for k in (0, 1)]
            if min(map(len, sides)) < p.least_side:
                continue
            middle = [np.median(s, axis=0) for s in sides]
            if away(*middle) < p.apart * np.median([away(r[6], middle[s]) for s, r in mine]):
                decisions[half, event] = "alike"
                continue
            first = first or middle
            keep, swap = sum(away(first[k], middle[k]) for k in (0, 1)), sum(away(first[k], middle[1 - k]) for k in (0, 1))
            decisions[half, event] = "swapped" if swap < keep else "kept"
            kept += [(half, event, s, r[6]) for s, r in mine] if swap >= keep else []
    halves = sorted({k[0] for k in kept})
    groups = {(h, s): [c for a, _, b, c in kept if (a, b) == (h, s)] for h in halves for s in (0, 1)}
    if not groups or min(map(len, groups.values())) < p.least_examples:
        return decisions, {}, {}
    centre = {k: np.median(v, axis=0) for k, v in groups.items()}
    changed = {h: sum(away(centre[halves[0], k], centre[h, k]) for k in (0, 1)) >= sum(away(centre[halves[0], k], centre[h, 1 - k]) for k in (0, 1)) and h != halves[0] for h in halves}
    label = [s ^ changed[h] for h, _, s, _ in kept]
    flip = int(np.median([c[0] for (*_, c), k in zip(kept, label, strict=True) if k == 0]) > np.median([c[0] for (*_, c), k in zip(kept, label, strict=True) if k == 1]))
    label = np.array([k ^ flip for k in label])
    left = {h: int(changed[h]) ^ flip for h in halves}
    colours, times = np.array([c for *_, c in kept]), np.array([e for _, e, *_ in kept])
    middle = [np.median(colours[label == k], axis=0) for k in (0, 1)]
    limit = [max(p.outlier * np.median([away(c, middle[k]) for c in colours[label == k]]), p.least_limit) for k in (0, 1)]
    begun, width, team = min(r[2] for r in rows), 1000 * p.step_s, {}
    for r in rows:
        if r[4]:
            team[r[2], r[5]] = left[r[1]] if r[3] < L / 2 else 1 - left[r[1]]
            continue
        w = np.exp(-np.abs(times - (begun + width * ((r[2] - begun) // width + 0.5))) / (1000 * p.fade_s))
        d = [away(r[6], (colours * w[:, None])[label == k].sum(0) / w[label == k].sum()) for k in (0, 1)]
        team[r[2], r[5]] = int(np.argmin(d)) if min(d) <= p.slack * limit[int(np.argmin(d))] else -1
    return decisions, left, team


def tables(spark, *matches):
    rows, events = [r for m in matches for r in m[0]], [e for m in matches for e in m[1]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(events, EVENTS)


def test_kits_against_the_plain_rule(spark):
    matches = {"a": made_up("a", 1, mixed={(1, 1)}, wrong={(2, 3)}), "b": made_up("b", 2, ends_change=False), "c": made_up("c", 3, mixed={(h, k) for h in (1, 2) for k in range(4)}), "d": made_up("d", 4, halves=1)}
    players, kicked = tables(spark, *matches.values())
    found = kt.teams_by_kits(players.drop("descriptor"), kicked, P)
    got = {name: found[name].collect() for name in ("decisions", "sides", "teams")}
    for match, (rows, events, team_of) in matches.items():
        decisions, left, team = plain_kits(rows, events, P)
        assert {(r.half, r.event): r.decision for r in got["decisions"] if r.match_id == match} == decisions
        assert {r.half: r.left_team for r in got["sides"] if r.match_id == match} == left
        mine = {(r.t, r.who): r.team for r in got["teams"] if r.match_id == match}
        assert len(mine) == len(rows)
        if not left:
            assert set(mine.values()) == {None}
            continue
        assert mine == team
        right = [mine[t, n] == 1 - team_of[match, t, n] for t, n in mine if mine[t, n] != -1 and (t % 50_000) > 2000]  # team 1 of made_up is the darker one
        assert np.mean(right) > 0.95
    assert {r.decision for r in got["decisions"]} == {"kept", "alike", "swapped"}
    assert {r.half: r.swapped for r in got["sides"] if r.match_id == "a"} == {1: False, 2: True} and not any(r.swapped for r in got["sides"] if r.match_id == "b")


def plain_discriminant(x, y, shrink):
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    c = [z[y == k].mean(0) for k in (0, 1)]
    s = np.cov(np.concatenate([z[y == k] - c[k] for k in (0, 1)]).T)
    s = (1 - shrink) * s + shrink * np.eye(len(s)) * np.trace(s) / len(s)
    w = np.linalg.solve(s, c[1] - c[0])
    return lambda v: ((v - mean) / scale) @ w - w @ (c[0] + c[1]) / 2


@pytest.mark.parametrize("turns", [0, 2])
def test_descriptors_against_the_plain_rule(spark, turns):
    matches = {"a": made_up("a", 5, wrong={(1, 1)}), "b": made_up("b", 6, ends_change=False)}
    players, kicked = tables(spark, *matches.values())
    found = kt.teams_by_descriptors(players, kicked, 4, ["match_id", "t", "who"], P, turns=turns)
    sides, teams = found["sides"].collect(), found["teams"].collect()
    for match, (rows, events, team_of) in matches.items():
        mine = [r for r in teams if r.match_id == match]
        assert len(mine) == len(rows)
        assert {r.half: r.swapped for r in sides if r.match_id == match} == {1: False, 2: match == "a"}
        outfield = [r for r in mine if not r.keeper and r.team is not None and (r.t % 50_000) > 2000]
        assert np.mean([r.team == 1 - team_of[match, r.t, r.who] for r in outfield]) > 0.95
        assert all(r.team is None for r in mine if r.score is None and not r.keeper)
        if turns:
            continue
        sure = [e for e in events if e[3] or e[2] - 300_000 * (e[1] - 1) < 90_000]
        taken = [(h, s, r[7]) for h, _, _, e in plain_examples([r for r in rows if r[7] is not None], sure, P) for s, r in e]
        y = np.array([s ^ (h == 2 and match == "a") for h, s, _ in taken])
        score = plain_discriminant(np.array([v for *_, v in taken]), y, P.shrink)
        flip = next(r.left_team for r in sides if r.match_id == match and r.half == 1)
        wanted = {(r[2], r[5]): (-1 if flip else 1) * score(np.array(r[7])) for r in rows if r[7] is not None}
        got = {(r.t, r.who): r.score for r in mine if r.score is not None}
        assert got.keys() == wanted.keys() and np.allclose([got[k] for k in wanted], list(wanted.values()), atol=1e-8)


def test_self_training_follows_a_changing_look(spark):
    """Away from the centre players look different; only those the model is sure of tell it how."""
    rng, rows, truth = np.random.default_rng(2), [], {}
    kicks = [("m", 1, 1000 * k, True, 1000 * k, 1000 * k) for k in range(2)]
    for t in [0, 1000, *range(5000, 205_000, 500)]:
        for n in range(8):
            team, start = n % 2, t <= 1000
            x = (15.0 if team == 0 else 40.0) if start else float(rng.uniform(9, 47))
            look = rng.normal(0, 0.6, 2) + np.array([2.0 if team else -2.0, 0.0])
            if not start:
                look += np.array([1.2, 3.0 if team else -3.0])
            truth[t, n] = team
            rows.append(("m", 1, t, x, False, n, [50.0 if team == 0 else 90.0, 1.0, 1.0], look.tolist()))
    players, kicked = tables(spark, (rows, kicks))
    p = kt.Kits(least_examples=4, least_pseudo=20, most_pseudo=500)
    share = []
    for turns in (0, 2):
        got = kt.teams_by_descriptors(players, kicked, 2, ["match_id", "t", "who"], p, turns=turns)["teams"].collect()
        share.append(np.mean([r.team == truth[r.t, r.who] for r in got]))
    assert share[1] > share[0] and share[1] > 0.99


def test_no_kickoffs_no_teams(spark):
    players, _ = tables(spark, made_up("a", 1))
    none = spark.createDataFrame([], EVENTS)
    assert {r.team for r in kt.teams_by_kits(players.drop("descriptor"), none, P)["teams"].collect()} == {None}
    assert {r.team for r in kt.teams_by_descriptors(players, none, 4, ["match_id", "t", "who"], P, turns=1)["teams"].collect()} == {None}
