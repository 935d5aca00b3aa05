"""Near duplicates against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa

from marlstone.llm import near_duplicates as nd
from marlstone.llm.near_duplicates import all_pairs, grouped, near_duplicates


def brute(rows, threshold=0.6):
    sets = {}
    for i, title, text in rows:
        if i is not None:
            sets[i] = set(re.findall("[a-z0-9]+", f"{title or ''} {text or ''}".lower()))
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                out.add((a, b))
    return out


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(150):
        words = rng.choices(vocabulary, k=60)
        rows.append((i, " ".join(words[:5]), " ".join(words)))
        if i % 3 == 0:
            for step in range(3):
                words = [w for w in words if rng.random() > 0.04] + rng.choices(vocabulary, k=2)
                rng.shuffle(words)
                rows.append((1000 + 10 * i + step, None, " ".join(words).upper() + "!"))
    return rows + [(5000, "", ""), (5001, None, None), (5002, "???", ""), (5003, "same", "words"), (5004, "words", "same"), (5005, "words same", ""), (None, "same", "words"), (5006, "x", "long " * 200_000)]


def test_pairs_and_groups(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "clash") for r in [*rows, rows[0], rows[40]]], "id bigint, title string, text string, sig int, words string")
    found = near_duplicates(df, "id", ["title", "text"])
    got = {tuple(r) for r in all_pairs(found).collect()}
    want = brute(rows)
    assert got == want and len(want) > 100
    groups = {r.id: r for r in grouped(found).collect()}
    assert len(groups) == len({r[0] for r in rows if r[0] is not None})
    assert {groups[i].class_id for i in (5003, 5004, 5005)} == {5003} and groups[5004].copies == 3 and groups[5000].copies == 1


def test_many_copies_and_a_crowd(spark):
    copies = [(i, "t", "one text that was delivered again and again") for i in range(300)]
    crowd = [(1000 + i, "t", " ".join(f"base{k}" for k in range(40)) + f" own{i}") for i in range(60)]
    df = spark.createDataFrame(copies + crowd, "id bigint, title string, text string")
    found = near_duplicates(df, "id", ["title", "text"])
    assert found.links.count() == 60 * 59 // 2
    assert found.members.where("class_id = 0").count() == 300


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, title string, text string")
    found = near_duplicates(df, "id", ["title", "text"])
    assert all_pairs(found).count() == grouped(found).count() == 0


def test_edits_on_uncommon_words_of_a_common_template(spark):
    rng = random.Random(11)
    template = [f"common{i}" for i in range(34)]
    rows = []
    for i in range(300):
        own = [f"u{i}x{j}" for j in range(26)]
        rows.append((2 * i, "", " ".join(template + own)))
        kept = rng.sample(own, 13)  # 47 of 73 words are common to both: 0.64, but 13 of 39 uncommon ones: 0.33
        rows.append((2 * i + 1, "", " ".join(template + kept + [f"v{i}x{j}" for j in range(13)])))
    rows += [(10_000 + i, "", " ".join(f"z{i}y{j}" for j in range(30))) for i in range(600)]
    got = {tuple(r) for r in all_pairs(near_duplicates(spark.createDataFrame(rows, "id bigint, title string, text string"), "id", ["title", "text"])).collect()}
    want = brute(rows)
    assert len(want) == 300 and got <= want and len(got) >= 0.98 * len(want)


def test_bits_agree_as_often_as_records_are_similar():
    rng = np.random.default_rng(2)
    a, b = [], []
    for _ in range(400):
        own = rng.integers(-(2**31), 2**31, 100).astype(np.int32)
        a.append(np.sort(own[:80]))
        b.append(np.sort(own[20:]))  # 60 of 100
    (a1, a2), (b1, b2) = nd.min_bits(a), nd.min_bits(b)
    same = 128 - np.bitwise_count((a1 ^ b1).view(np.uint64)) - np.bitwise_count((a2 ^ b2).view(np.uint64))
    assert abs(same.mean() - 0.8 * 128) < 1 and (same >= nd.AGREE).all()


def test_an_id_with_two_texts(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "eins zwei drei vier fuenf sechs"
    rows = [(5, one, ""), (5, two, ""), (9, one, ""), (12, two, "")]
    found = nd.near_duplicates(spark.createDataFrame(rows, "id bigint, title string, text string"), "id", ["title", "text"])
    classes = {r.id: r.class_id for r in found.members.collect()}
    pairs = {tuple(r) for r in nd.all_pairs(found).collect()}
    assert classes[9] != classes[12] and pairs in ({(5, 9)}, {(5, 12)}) and len(classes) == 3


def test_a_crowd_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(nd, "RUN", 8)
    rng = random.Random(5)
    template = " ".join(f"t{i}" for i in range(40))
    rows = [(i, template, " ".join(f"w{rng.randrange(3000)}" for _ in range(8))) for i in range(120)]
    rows += [(1000 + i, f"x{i} y{i} z{i}", " ".join(f"v{i * 31 + j}" for j in range(9))) for i in range(50)]
    found = nd.near_duplicates(spark.createDataFrame(rows, "id bigint, title string, text string"), "id", ["title", "text"])
    words = {i: frozenset(f"{a} {b}".split()) for i, a, b in rows}
    want = {(i, j) for i in words for j in words if i < j and len(words[i] & words[j]) >= 0.6 * len(words[i] | words[j])}
    assert {tuple(r) for r in nd.all_pairs(found).collect()} == want and len(want) > 5_000


def test_signatures_travel_packed(monkeypatch):
    monkeypatch.setattr(nd, "RUN", 8)
    monkeypatch.setattr(nd, "BUCKET", 100)  # more than 4 times as many signatures in a bucket: crowds are passed on early
    rng = np.random.default_rng(9)
    rows = rng.integers(0, 2**35, (500, 20)).astype(np.uint64)
    rows[:, 0] = 7 << 30  # a crowd of all
    rows[100:200:2, 1] = rows[101:200:2, 1]
    rows[300:306, 2] = rows[300, 2]
    rows[400:, 3] = 2**35 - 1
    records = np.stack([rng.permutation(500) - 40, np.zeros(500, int), np.zeros(500, int)], axis=1)
    packed = [nd._packed(rows[i : i + 125], records[i : i + 125], 9, 35) for i in range(0, 500, 125)]
    assert all(p.num_rows <= 9 for p in packed) and sum(p.num_rows for p in packed) < rows.size / 200
    table = pa.Table.from_batches(packed).sort_by("bucket")
    pairs, crowds = set(), {}
    for batch in nd._runs(table.to_batches(max_chunksize=5)):
        for r in batch.to_pylist():
            if r["b"] is None:
                crowds.setdefault(r["sig"], []).append(r["a"])
            else:
                pairs.add((r["a"], r["b"]))
    holders = {}
    for i, own in zip(records[:, 0].tolist(), rows.tolist(), strict=True):
        for sig in own:
            holders.setdefault(sig, []).append(i)
    assert pairs == {(a, b) for h in holders.values() if len(h) <= 8 for a in h for b in h if a < b} and len(pairs) >= 65
    assert sorted(map(sorted, crowds.values())) == sorted(sorted(h) for h in holders.values() if len(h) > 8) and len(crowds) == 2
