"""Replay of game feeds by hand: runners by base, mid-episode changes of the actor, chained movements, the automatic runner."""

import json

import pytest

from tallylane.keys import DEFAULT_KEYS as K
from tallylane.sources import game_feed


def document(half_plays, kind="F"):
    """A feed from (inning, side, actor, result, steps, moves) for each play.

    A step is (index, what, balls, strikes[, player]): `what` is a call code, +code for an automatic call, or an action's name.
    A move is (index, runner, path): the path goes from base to base, - for none, x for an out, H for home.
    """
    names = {"1": "1B", "2": "2B", "3": "3B", "H": "score"}
    plays = []
    for number, (inning, side, actor, result, steps, moves) in enumerate(half_plays):
        events, runners = [], []
        for index, what, balls, strikes, *player in steps:
            event = {"index": index, "count": {"balls": balls, "strikes": strikes}, "details": {}}
            if what[0] == "+":
                event |= {"isPitch": False, "type": "no_pitch", "details": {"call": {"code": what[1:]}}}
            elif "_" in what:
                event |= {"isPitch": False, "type": "action", "details": {"eventType": what}, "player": {"id": player[0]} if player else None}
            else:
                event |= {"isPitch": True, "type": "pitch", "details": {"call": {"code": what}, "type": {"code": "SL"}}, "pitchData": {"startSpeed": 88.5, "breaks": {"breakHorizontal": -6.0, "breakVerticalInduced": 3.0}}}
            events.append(event)
        for index, runner, path in moves:
            for a, b in zip(path, path[1:], strict=False):
                runners.append({"movement": {"start": names.get(a), "end": names.get(b), "isOut": b == "x"}, "details": {"playIndex": index, "runner": {"id": runner}}})
        plays.append({
            "about": {"atBatIndex": number, "inning": inning, "isTopInning": side == "Top"} | ({"isComplete": False} if result is None else {}), "result": {"eventType": result, "description": result},
            "matchup": {"pitcher": {"id": actor}, "pitchHand": {"code": "S"}, "batter": {"id": 500 + number}, "batSide": {"code": "R"}}, "playEvents": events, "runners": runners})
    players = {f"ID{i}": {"pitchHand": {"code": hand}} for i, hand in ((61, "R"), (62, "L"))}
    return json.dumps({"gameData": {"game": {"pk": 7, "type": kind}, "datetime": {"officialDate": "2025-04-03"}, "players": players}, "liveData": {"plays": {"allPlays": plays}}})


def flat(spark, plays, kind="F", **options):
    found = game_feed.flatten_game_feed(spark.createDataFrame([(document(plays, kind),)], "body string"), K, **options).collect()
    return {(r.at_bat_number, r.pitch_number): r for r in found}


def test_replay_by_hand(spark):
    rows = flat(spark, [
        (1, "Top", 61, "walk", [(0, "C", 0, 1), (1, "+V", 1, 1), (2, "B", 2, 1), (3, "B", 3, 1), (4, "B", 4, 1)], [(4, 500, "-1")]),
        # another runner takes over without a movement, steals, scores; another pitcher takes over after two pitches
        (1, "Top", 62, "triple", [(0, "offensive_substitution", 0, 0, 900), (1, "B", 1, 0), (2, "stolen_base", 1, 0), (3, "F", 1, 1), (4, "pitching_substitution", 1, 1, 62), (5, "X", 1, 1)], [(2, 900, "12"), (5, 501, "-3"), (5, 900, "2H")]),
        (1, "Top", 62, "field_out", [(0, "X", 0, 0)], [(0, 502, "-x"), (0, 501, "3H")]),
        (1, "Top", 62, "single", [(0, "X", 0, 0)], [(0, 503, "-12")]),
        (1, "Top", 62, "field_out", [(0, "S", 0, 1), (1, "X", 0, 1)], [(1, 504, "-x"), (1, 503, "2x")]),
        (1, "Bot", 70, "home_run", [(0, "X", 0, 0)], [(0, 505, "-H")])])
    assert [(rows[(1, i)].balls, rows[(1, i)].strikes, rows[(1, i)].description) for i in range(1, 6)] == [(0, 0, "called_strike"), (0, 1, "automatic_ball"), (1, 1, "ball"), (2, 1, "ball"), (3, 1, "ball")]
    assert rows[(1, 2)].pitch_type is None and rows[(1, 2)].release_speed is None and [rows[(1, i)].events for i in (4, 5)] == [None, "walk"]
    before, between, behind = (rows[(2, i)] for i in (1, 2, 3))
    assert [(r.pitcher, r.p_throws, r.bases) for r in (before, between, behind)] == [(61, "R", 1), (61, "R", 2), (62, "S", 2)]
    assert (before.on_1b, between.on_2b) == (500, 900) and (between.post_away_score, behind.away_score, behind.post_away_score) == (0, 0, 1)
    assert (rows[(3, 1)].on_3b, rows[(3, 1)].outs_when_up, rows[(4, 1)].bases, rows[(4, 1)].outs_when_up, rows[(4, 1)].away_score) == (501, 0, 0, 1, 2)
    assert (rows[(5, 1)].bases, rows[(5, 1)].on_2b, rows[(5, 2)].outs_when_up) == (2, 503, 1)
    assert (rows[(6, 1)].outs_when_up, rows[(6, 1)].bases, rows[(6, 1)].post_home_score, rows[(6, 1)].post_away_score, rows[(6, 1)].inning_topbot) == (0, 0, 1, 2, "Bot")
    assert rows[(2, 1)].pfx_x == pytest.approx(0.5) and rows[(2, 1)].pfx_z == pytest.approx(0.25) and rows[(2, 1)].effective_speed == 88.5
    assert str(rows[(2, 1)].game_date) == "2025-04-03"


def test_halves_outs_and_the_automatic_runner(spark):
    plays = [
        (10, "Top", 61, "single", [(0, "X", 0, 0)], [(0, 1, "-1")]), (10, "Top", 61, "field_out", [(0, "B", 1, 0), (1, "X", 1, 0)], [(0, 1, "1x"), (1, 2, "-x")]),
        (10, "Top", 61, "caught_stealing_2b", [(0, "F", 0, 1), (1, "F", 0, 2)], [(None, -1, "2H")]), (10, "Bot", 70, None, [(0, "zz", 0, 0)], [])]
    rows = flat(spark, plays, "R", effective_speed=False)
    assert [(rows[k].outs_when_up, rows[k].bases, rows[k].on_2b, rows[k].away_score) for k in ((1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1))] == [
        (0, 2, -1, 0), (0, 3, -1, 0), (1, 2, -1, 0), (2, 2, -1, 0), (2, 2, -1, 0), (0, 2, -1, 1)]
    assert rows[(3, 2)].events == "truncated_pa" and rows[(4, 1)].events is None and rows[(4, 1)].description == "unmapped:zz" and rows[(3, 2)].post_away_score == 1
    assert {r.effective_speed for r in rows.values()} == {None} and flat(spark, plays, "F")[(1, 1)].bases == 0


def test_no_plays_no_rows(spark):
    assert flat(spark, []) == {} and flat(spark, [(1, "Top", 61, "x", [], [])]) == {}
    docs = spark.createDataFrame([(None,), ("{}",), ("no document",)], "body string")
    assert game_feed.flatten_game_feed(docs, K).count() == 0
