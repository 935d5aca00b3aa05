"""Neighbours against all cosines."""

import numpy as np
import pytest

from marlstone.llm import vector_neighbours
from marlstone.llm.vector_neighbours import neighbours, pairs

SCHEMA = "episode_id bigint, embedder_id string, dimensions int, vector array<tinyint>, similarity int"


def brute(rows, k=5, least=0.8):
    good = {i: (e, np.array(v, float)) for i, e, d, v, _ in rows if i is not None and e is not None and v is not None and len(v) == d and any(v)}
    out = set()
    for i, (e, x) in good.items():
        near = sorted((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 12), j) for j, (f, y) in good.items() if j != i and f == e and len(y) == len(x))
        out |= {(min(i, j), max(i, j)) for c, j in near[:k] if -c >= least}
    return out


def test_recall_and_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(96) * 10
        for j in range(rng.integers(1, 9)):
            rows.append((len(rows) + 1, "m1" if c % 5 else "m2", 96, np.clip(centre + rng.standard_normal(96) * 4, -127, 127).astype(int).tolist(), 0))
    same = rows[3][3]
    rows += [(900 + j, rows[3][1], 96, same, 0) for j in range(9)]
    rows += [(950, "m1", 96, None, 0), (951, "m1", 96, [0] * 96, 0), (952, "m1", 96, same[:90], 0), (None, "m1", 96, same, 0), (953, None, 96, same, 0), (954, "m3", 96, same, 0), (955, "m1", None, same, 0), rows[0], rows[7]]
    df = spark.createDataFrame(rows, SCHEMA)
    found = neighbours(df)
    got, want = {tuple(r) for r in pairs(found).collect()}, brute(rows)
    assert len(got & want) >= 0.98 * len(want) > 50
    assert found.where("similarity < 0.8 or episode_id = neighbour_id").count() == 0
    assert found.groupBy("episode_id").count().where("count > 5").count() == 0


def test_empty(spark):
    assert neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("length", "block"), [(None, None), (6, 200)])
def test_a_third_in_one_topic(spark, monkeypatch, length, block):
    if length:
        monkeypatch.setattr(vector_neighbours, "layout", lambda sample, count, least, missed: (length, vector_neighbours.substrings_for(length, least, missed)))
        monkeypatch.setattr(vector_neighbours, "BLOCK", block)
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(384)
    topic = centre * 2 + rng.standard_normal((1_000, 384))
    near = topic[::4] + 0.45 * rng.standard_normal((250, 384))
    vectors = np.concatenate([topic, near, rng.standard_normal((2_500, 384))])
    quantised = np.clip(vectors / np.linalg.norm(vectors, axis=1, keepdims=True) * 600, -127, 127).astype(int)
    rows = [(i, "m1", 384, v.tolist(), 0) for i, v in enumerate(quantised)]
    x = quantised / np.linalg.norm(quantised, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(s)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.8}
    got = {tuple(r) for r in pairs(neighbours(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(want) > 3_000 and len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


@pytest.mark.parametrize("count", [1_000, 100_000, 1_000_000, 16_000_000])
def test_modelled_recall_at_every_size(count):
    rng = np.random.default_rng(1)
    for sample in (rng.standard_normal((500, 64)), rng.standard_normal((500, 64)) + 2 * (np.arange(500)[:, None] < 170)):
        length, strings = vector_neighbours.layout(sample, count, 0.8)
        same = 1 - np.arccos(0.8) / np.pi
        assert 1 - (1 - same**length - length * (1 - same) * same ** max(0, length - 1)) ** strings >= 1 - vector_neighbours.MISSED
        assert strings < 2_048


@pytest.mark.parametrize("length", [10, 20, 24])
def test_recall_of_long_substrings(length):
    """What a collection of millions would use: pairs of cosine 0.8 and 0.85 meet as often as the model says."""
    rng = np.random.default_rng(3)
    strings = vector_neighbours.substrings_for(length, 0.8)
    for sample in (rng.standard_normal((600, 384)), rng.standard_normal((600, 384)) + 1.5 * (np.arange(600)[:, None] < 300)):
        turn = vector_neighbours.learned(sample, max(256, -(-length * strings // 64) * 64))
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        for cosine in (0.8, 0.85):
            u = rng.standard_normal(x.shape)
            u -= (u * x).sum(axis=1, keepdims=True) * x
            y = cosine * x + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
            off = (x @ turn > 0) != (y @ turn > 0)
            meet = (off[:, : length * strings].reshape(len(x), strings, length).sum(axis=2) <= 1).any(axis=1)
            near = off.sum(axis=1) <= vector_neighbours.radius(off.shape[1], 0.8)
            assert (meet & near).mean() >= 0.995
