"""Tree contraction against walking the parents one by one."""

import random

from marlstone import queries_core
from marlstone.operators.hierarchy import descendants, parent_links, resolve


def walked(parents):
    out = {}
    for node in parents:
        chain, at = [node], node
        while parents[at] in parents and len(chain) <= len(parents):
            at = parents[at]
            chain.append(at)
        out[node] = (None, None, True, None) if len(chain) > len(parents) else (at, len(chain) - 1, False, chain[::-1])
    return out


def check(spark, parents):
    links = spark.createDataFrame(list(parents.items()), "id string, parent string")
    got = {r.id: (r.root, r.depth, r.cyclic, r.path) for r in resolve(links, with_paths=True).collect()}
    assert got == walked(parents)
    assert {r.id: (r.root, r.depth) for r in resolve(links).collect()} == {k: v[:2] for k, v in walked(parents).items()}


def test_shapes(spark):
    chain = {f"c{i}": f"c{i - 1}" for i in range(1, 60)} | {"c0": None}
    star = {f"s{i}": "s" for i in range(40)} | {"s": "missing"}
    loops = {"x": "y", "y": "x", "z": "x", "zz": "z", "self": "self", "under": "self"} | {f"l{i}": f"l{(i + 1) % 7}" for i in range(7)} | {"lt": "l3"}
    rng = random.Random(5)
    wild = {f"r{i}": f"r{rng.randrange(60)}" for i in range(60)}
    check(spark, chain | star | loops | wild)


def test_empty(spark):
    assert resolve(spark.createDataFrame([], "id string, parent string"), True).count() == 0


def test_links_blank_parents_repeats_and_extra_columns(spark):
    rows = [("a", None, 1, 9), ("b", "", 1, 9), ("c", "0000", 1, 9), ("d", "a", 1, 9), ("d", "b", 2, 9), ("d", "b", 2, 9), (None, "a", 1, 9), ("", "a", 1, 9)]
    df = spark.createDataFrame(rows, "node string, up string, stamp int, n int")
    assert {r.id: r.parent for r in parent_links(df, "node", "up", ["stamp"]).collect()} == {"a": None, "b": None, "c": None, "d": "b"}


def test_descendants(spark):
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string")
    assert {tuple(r) for r in descendants(resolve(links, True)).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_descendants_of_whole_forests(spark):
    folder = "/root/testdata/sf0.001"
    whole = {(r.tree, r.node_id): r.depth for r in queries_core.p7_hierarchy(spark, folder).where("depth is not null").collect()}
    below = queries_core.queries()["p7_descendants"](spark, folder).collect()
    assert len(below) == len(set(below)) == sum(whole.values()) > 0
    assert all(whole[r.tree, r.descendant] - whole[r.tree, r.node_id] == r.distance > 0 for r in below)
