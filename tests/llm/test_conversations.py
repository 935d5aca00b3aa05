"""Conversations: turns, versions, spellings, blanks, clocks."""

import datetime as dt

import numpy as np

from marlstone.llm.conversations import least_squares, rebuild

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "message_id string, session_id string, role string, text string, prompt string, generation_id string, sent_at timestamp, received_at timestamp, turn int, key string"


def table(spark, rows):
    made = []
    for mid, session, role, text, prompt, gen, sent, *received in rows:
        at = None if sent is None else T0 + dt.timedelta(seconds=sent)
        made.append((mid, session, role, text, prompt, gen, at, T0 + dt.timedelta(seconds=received[0] if received else (sent or 0) + 1), 7, "clash"))
    return spark.createDataFrame(made, SCHEMA)


def verdicts(spark, rows, skew=0.0):
    return {r.session_id: r.ok for r in rebuild(table(spark, rows), skew).sessions.collect()}


def test_verdicts(spark):
    rows = [
        ("a1", "fine", " USER ", "hi", None, "g", 1), ("a2", "fine", "Model", "yes", None, "g", 2),
        ("b1", "no reply", "user", None, "hi", "g", 1),
        ("c1", "blank reply", "human", "hi", None, None, 1), ("c2", "blank reply", "ai", "​﻿  ", None, None, 2),
        ("d1", "no turn", "system", "x", None, None, 1), ("d2", "no turn", "tool", "x", None, None, 2),
        ("e1", "answer first", "assistant", "x", None, None, 1), ("e2", "answer first", "user", "x", None, None, 2), ("e3", "answer first", "ai", "x", None, None, 3),
        ("f1", "null role", None, None, "hi", None, 1), ("f2", "null role", "assistant", "x", None, None, 2),
        ("g1", "gen reused", "user", "x", None, "g", 1), ("g2", "gen reused", "assistant", "x", None, "g", 2),
        ("h1", None, "user", "x", None, "g", 1), ("h2", "", "user", "x", None, "g", 1),
        ("i1", "two asks", "user", "x", None, None, 1), ("i2", "two asks", "user", "x", None, None, 2), ("i3", "two asks", "assistant", "x", None, None, 3),
        ("j1", "late", "assistant", "x", None, "g", 5), ("j2", "late", "user", "x", None, "g", 8),
        ("k1", "no time", "user", "x", None, "g", None), ("k2", "no time", "assistant", "x" * 100_000, None, "g", 3),
    ]
    want = {"fine": True, "no reply": False, "blank reply": False, "no turn": False, "answer first": False, "null role": True, "gen reused": True, "two asks": False, "late": False, "no time": True}
    assert verdicts(spark, rows) == want
    assert verdicts(spark, rows, 2.0) == want | {"late": True}


def test_last_received_version_counts_and_repeats_do_not(spark):
    rows = [("m", "s", "user", "old", None, None, 1, 5), ("m", "s", "user", " ", None, None, 1, 9), ("n", "s", "assistant", "x", None, None, 2), ("n", "s", "assistant", "x", None, None, 2)]
    assert verdicts(spark, rows) == {"s": False}
    assert verdicts(spark, [(*r[:6], r[6], 14 - r[7]) if r[0] == "m" else r for r in rows]) == {"s": True}


def test_order_and_offsets(spark):
    rows = [("q1", "s", "user", "one", None, "g1", 10), ("r1", "s", "assistant", "1", None, "g1", 7), ("q2", "s", "user", "two", None, "g2", 20), ("t", "s", "tool", "x", None, None, 18), ("r2", "s", "assistant", "2", None, "g2", 21)]
    out = rebuild(table(spark, rows), 5.0)
    s = out.sessions.first()
    assert s.ok and round(s.assistant_offset, 3) == 1.5 and round(s.user_offset, 3) == -1.5
    assert [(r.message_id, r.turn, r.position) for r in out.messages.orderBy("position").collect()] == [("q1", 1, 1), ("r1", 1, 2), ("t", None, 3), ("q2", 2, 4), ("r2", 2, 5)]


def test_empty(spark):
    out = rebuild(table(spark, []))
    assert out.sessions.count() == out.messages.count() == 0


def test_least_squares_of_three_clocks():
    rng = np.random.default_rng(4)
    need = rng.uniform(-6, 2, (300, 3, 3))
    need[rng.random(need.shape) < 0.4] = -np.inf
    got, feasible = least_squares(need, 5.0)
    grid = np.stack(np.meshgrid(*[np.arange(-5, 5.01, 0.25)] * 3, indexing="ij"), -1).reshape(-1, 3)
    for i in range(300):
        slack = lambda x: np.min([x[..., b] - x[..., a] - need[i, a, b] for a in range(3) for b in range(3) if a != b], axis=0)
        good = grid[slack(grid) >= 0]
        if feasible[i]:
            assert slack(got[i]) >= -1e-6 and np.abs(got[i]).max() <= 5 + 1e-6
            if len(good):  # no point of the grid is better
                assert (got[i] ** 2).sum() <= (good**2).sum(axis=1).min() + 1e-6
        else:
            assert not len(good)
    assert feasible.sum() > 100 and (~feasible).sum() > 20


def test_tools_bound_both_clocks(spark):
    # The tool's answer is sent before its prompt and the assistant's before the tool's call: three clocks must move.
    rows = [("q", "s", "user", "one", None, "g", 10), ("t", "s", "tool", "out", None, "g", 8), ("r", "s", "assistant", "1", None, "g", 6)]
    out = rebuild(table(spark, rows), 5.0)
    s = out.sessions.first()
    assert s.ok and [round(x, 2) for x in (s.user_offset, s.tool_offset, s.assistant_offset)] == [-2.0, 0.0, 2.0]
    assert [r.message_id for r in out.messages.orderBy("position").collect()] == ["q", "t", "r"]
    assert not rebuild(table(spark, rows), 1.0).sessions.first().ok
    assert rebuild(table(spark, rows), 5.0, ("user", "assistant")).sessions.first().assistant_offset == 2.0000005
