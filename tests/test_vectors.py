import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import vectors as v


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((20, 64))
    rows = [(i, (base[i % 20] + 0.2 * rng.standard_normal(64)).tolist()) for i in range(40)]
    return spark.createDataFrame([*rows, (90, None), (91, [0.0] * 64), (92, [1.0])], "id bigint, vec array<double>").cache()


def test_search_and_codes(spark, table):
    rows = {r.id: np.array(r.vec) for r in table.where("id < 40").collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    best = v.keyword_search(table, "vec", [rows[0].tolist(), rows[20].tolist()], 2).collect()
    want = sorted(rows, key=lambda i: -min(cos(rows[i], rows[0]), cos(rows[i], rows[20])))[:2]
    assert {r.id for r in best} == set(want)
    true = cos(rows[0], rows[20])
    for codes, score, want in ((v.shape_codes(table, "id", "vec", 64), v.shape_score("a", "b"), 2 / np.pi * np.arcsin(true)), (v.rotated_codes(table, "id", "vec", 64), v.rotated_score("a", "b"), true)):
        c = codes.cache()
        pair = c.where("id = 0").select(F.col("code").alias("a")).join(c.where("id = 20").select(F.col("code").alias("b"))).select(score.alias("s")).first().s
        assert abs(pair - want) < 0.05 and c.count() == 41
    unit = table.where("id = 0").select(v.int8_unit("vec").alias("u")).first().u
    assert abs(cos(np.array(unit, float), rows[0]) - 1) < 1e-3


def test_embedding(spark):
    df = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "the quick brown fox leaps"), (3, "unrelated words entirely here"), (4, ""), (5, None)], "id bigint, t string")
    e = {r.id: np.array(r.code, float) for r in v.hashed_embedding(df, "id", "t").collect()}
    near, far = e[1] @ e[2], e[1] @ e[3]
    assert near > 3 * abs(far) and not e[4].any() and set(e) == {1, 2, 3, 4}


def test_proximity(spark):
    rows = [("a/b/x", "a/b/y", 1.1), ("a/b/x", "a/c/y", 1.05), ("x", "y", 1.0), ("a/x", "a/b/c/d", 1 + 0.1 / 3)]
    got = spark.createDataFrame(rows, "a string, b string, want double").withColumn("got", v.path_proximity("a", "b")).collect()
    assert all(abs(r.got - r.want) < 1e-9 for r in got)


def test_communities(spark):
    pairs = [(a, b, 1.0) for block in (range(5), range(10, 15)) for a in block for b in block if a < b] + [(4, 10, 1.0)]
    assert v.leiden(pd.DataFrame(pairs, columns=["a", "b", "w"])) == {n: 0 if n < 5 else 10 for n in (*range(5), *range(10, 15))}
    assert {r.id: r.community for r in v.communities(spark.createDataFrame(pairs, "a bigint, b bigint, w double")).collect()}[12] == 10
    with pytest.raises(ValueError):
        v.communities(spark.createDataFrame(pairs, "a bigint, b bigint, w double"), most=3)


def test_links(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in range(20)], "source_id bigint, target_id bigint, score double")
    assert sorted(r.target_id for r in v.greedy_links(df, 3).collect()) == [0, 1, 2]
