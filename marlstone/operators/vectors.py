"""Vector codes and searches: quantising, sign codes, keyword search, min-hash families.

Numpy on Arrow batches where Spark has no expression; every function maps rows, so nothing is shuffled but the
results.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signed dimensions of a token, and places of its random index.
TOKEN_SIGNS, SHAPE_BITS, ROTATED = 8, 10_000, 1024


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two array columns; null if one is null, all zero, or of another length."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), length))


def int8_unit(vector: str) -> Column:
    """The vector scaled to unit length and rounded to steps of 1/127."""
    size = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.round(F.coalesce(F.try_divide(x.cast("double"), size), F.lit(0.0)) * 127).cast("tinyint"))


def keyword_search(df: DataFrame, vector: str, keywords: list[list[float]], limit: int | None = None) -> DataFrame:
    """``df`` with ``score``: the least cosine with any of the keyword vectors, so all must fit."""
    if not 0 < len(keywords) <= 32:
        raise ValueError("1 to 32 keyword vectors")
    scores = [cosine(F.col(vector), F.array(*map(F.lit, map(float, k)))) for k in keywords]
    scored = df.withColumn("score", scores[0] if len(scores) == 1 else F.least(*scores)).where("score is not null")
    return scored if limit is None else scored.orderBy(F.desc("score")).limit(limit)


def _batches(df: DataFrame, key: str, column: str, make, schema: str):
    def run(frames):
        for batch in frames:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), make(batch.column(1))], ["id", "code"])

    return df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("bigint").alias("id"), column).mapInArrow(run, f"id bigint, code {schema}")


def token_vector(token: str, dims: int = 768) -> np.ndarray:
    """The random index of a token: eight hashed places of sign plus or minus."""
    out = np.zeros(dims, np.float32)
    for k in range(TOKEN_SIGNS):
        h = xxhash.xxh3_64_intdigest(token.encode(), seed=k)
        out[h % dims] += 1.0 if h >> 63 else -1.0
    return out


def hashed_embedding(df: DataFrame, key: str, text: str, dims: int = 384, clip: int = 1500) -> DataFrame:
    """``(id, code)``: unit int8 vectors of the words, word pairs and letter groups (3 to 5) of a text."""

    def features(t: str) -> list[str]:
        words = "".join(c if c.isalnum() else " " for c in t.lower()[:clip]).split()
        groups = [f"c:{w[i : i + n]}" for w in (f" {x} " for x in words) for n in (3, 4, 5) for i in range(len(w) - n + 1)]
        return [f"w:{w}" for w in words] + [f"b:{a} {b}" for a, b in zip(words, words[1:], strict=False)] + groups

    def embed(column):
        memo: dict[str, np.ndarray] = {}
        rows = np.zeros((len(column), dims), np.float32)
        for i, t in enumerate(column.to_pylist()):
            for f in features(t):
                if f not in memo:
                    if len(memo) > 20_000:
                        memo.clear()
                    memo[f] = token_vector(f, dims)
                rows[i] += memo[f]
        size = np.linalg.norm(rows, axis=1, keepdims=True)
        code = np.rint(np.divide(rows, size, out=np.zeros_like(rows), where=size > 0) * 127).astype(np.int8)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, dims, dtype=np.int32)), pa.array(code.reshape(-1)))

    return _batches(df, key, text, embed, "array<tinyint>")


def _stacked(column, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), dims)


def shape_codes(df: DataFrame, key: str, vector: str, dims: int, bits: int = SHAPE_BITS) -> DataFrame:
    """``(id, code)``: the signs of ``bits`` fixed random plus-minus sums of the vector, as words of 64 bits.

    Vectors of another length than ``dims`` are left out."""
    plane = np.random.default_rng(1).choice(np.array([-1.0, 1.0], np.float32), (dims, bits))
    words = -(-bits // 64)

    def code(column):
        on = np.zeros((len(column), words * 64), bool)
        on[:, :bits] = _stacked(column, dims) @ plane > 0
        packed = np.packbits(on, axis=1).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, packed.size + 1, words, dtype=np.int32)), pa.array(packed.reshape(-1)))

    return _batches(df.where(F.size(vector) == dims), key, vector, code, "array<bigint>")


def shape_score(a: str, b: str, bits: int = SHAPE_BITS) -> Column:
    """1 - 2 * differing bits / bits of two codes."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 1 - 2 * apart / F.lit(bits)


def rotated_codes(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``(id, code)``: unit vectors turned by fixed signs and a Walsh-Hadamard transform and laid on 16 levels between their own
    least and greatest coordinate, two to a byte.

    ``code`` is a struct of ``offset`` (the least), ``scale`` (the step), ``total`` (the sum of all levels) and ``levels``.
    """
    signs = np.array([1 if xxhash.xxh3_64_intdigest(struct.pack("<I", i), seed=0x5BD1E995) & 1 else -1 for i in range(ROTATED)], np.float32)

    def code(column):
        x = np.zeros((len(column), ROTATED), np.float32)
        x[:, :dims] = _stacked(column, dims)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0) * signs
        step = 1
        while step < ROTATED:
            y = x.reshape(len(x), -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), ROTATED)
            step *= 2
        x = x / np.float32(np.sqrt(ROTATED))
        low = x.min(axis=1, keepdims=True)
        span = x.max(axis=1, keepdims=True) - low
        scale = np.where(span > 0, span / 15, 1).astype(np.float32)
        level = np.clip(((x - low) / scale + 0.5).astype(np.int32), 0, 15)
        packed = (level[:, 0::2] | level[:, 1::2] << 4).astype(np.uint8)
        fields = [pa.array(low[:, 0]), pa.array(scale[:, 0]), pa.array(level.sum(axis=1, dtype=np.int32)), pa.array([r.tobytes() for r in packed], pa.binary())]
        return pa.StructArray.from_arrays(fields, ["offset", "scale", "total", "levels"])

    return _batches(df.where(F.size(vector) == dims), key, vector, code, "struct<offset: float, scale: float, total: int, levels: binary>")


def rotated_score(a: str, b: str) -> Column:
    """The inner product that two rotated codes stand for."""

    @F.pandas_udf("bigint")
    def levels(one: pd.Series, two: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1).astype(np.int64) for c in (one, two))
        return pd.Series(((x & 15) * (y & 15) + (x >> 4) * (y >> 4)).sum(axis=1))

    v = lambda c, f: F.col(f"{c}.{f}").cast("double")
    cross = v(a, "offset") * v(b, "scale") * v(b, "total") + v(b, "offset") * v(a, "scale") * v(a, "total")
    return ROTATED * v(a, "offset") * v(b, "offset") + cross + v(a, "scale") * v(b, "scale") * levels(F.col(f"{a}.levels"), F.col(f"{b}.levels"))


def greedy_links(scored: DataFrame, cap: int = 10) -> DataFrame:
    """Up to ``cap`` links of each source, the greatest ``score`` first, then the lower target."""
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id")
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def path_proximity(a: str, b: str) -> Column:
    """1 + 0.1 * leading directories two paths share / those of the deeper one."""
    da, db = (F.slice(F.split(c, "/"), 1, F.greatest(F.size(F.split(c, "/")) - 1, F.lit(0))) for c in (a, b))
    same = F.zip_with(da, db, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))
    deepest = F.greatest(F.size(da), F.size(db))
    return 1 + 0.1 * F.coalesce(F.try_divide(F.least(shared, F.size(da), F.size(db)), deepest), F.lit(0.0))


def leiden(edges: pd.DataFrame, gamma: float = 1.0, rounds: int = 64) -> dict[int, int]:
    """Communities of a bounded weighted graph ``(a, b, w)``: moves of single nodes for the greatest gain, then of whole
    communities, until nothing moves. Deterministic; the id of a community is its least node."""
    near: dict[int, dict[int, float]] = {}
    for a, b, w in edges[["a", "b", "w"]].itertuples(index=False):
        if a != b:
            near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0.0) + w
            near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0.0) + w
    home = {n: n for n in near}
    groups = {n: [n] for n in near}
    links = {n: dict(d) for n, d in near.items()}
    weight = {n: sum(d.values()) for n, d in near.items()}
    total = sum(weight.values())
    for _ in range(rounds):
        place, size = {n: n for n in links}, dict(weight)
        moved_any, queue = False, sorted(links)
        while queue:
            n = queue.pop(0)
            into: dict[int, float] = {}
            for other, w in links[n].items():
                into[place[other]] = into.get(place[other], 0.0) + w
            size[place[n]] -= weight[n]
            gain = lambda c: into.get(c, 0.0) - gamma * weight[n] * size[c] / total  # noqa: B023, E731
            best = max(sorted(into), key=lambda c: (gain(c), -c), default=place[n])
            if gain(best) > gain(place[n]) + 1e-12:
                place[n], moved_any = best, True
                queue += [o for o in sorted(links[n]) if place[o] != best and o not in queue]
            size[place[n]] += weight[n]
        if not moved_any:
            break
        merged: dict[int, list[int]] = {}
        for n, c in place.items():
            merged.setdefault(c, []).append(n)
        label = {c: min(ns) for c, ns in merged.items()}
        groups = {label[c]: [m for n in ns for m in groups[n]] for c, ns in merged.items()}
        fresh: dict[int, dict[int, float]] = {k: {} for k in groups}
        for n, d in links.items():
            for o, w in d.items():
                a, b = label[place[n]], label[place[o]]
                if a != b:
                    fresh[a][b] = fresh[a].get(b, 0.0) + w
        weight = {label[c]: sum(weight[n] for n in ns) for c, ns in merged.items()}
        links = fresh
    for members in groups.values():
        home.update(dict.fromkeys(members, min(members)))
    return home


def communities(edges: DataFrame, most: int = 8_000) -> DataFrame:
    """``(id, community)`` of an undirected graph ``(a, b, w)`` of at most ``most`` nodes; a larger one is refused.

    The edges are merged by a shuffle first; the bounded rest is solved by one task."""
    merged = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w"))
    count = merged.select(F.col("a").alias("n")).unionByName(merged.select(F.col("b").alias("n"))).distinct().count()
    if count > most:
        raise ValueError(f"{count} nodes are more than {most}")

    def solve(frames):
        rows = pd.concat(list(frames) or [pd.DataFrame({"a": [], "b": [], "w": []})]).sort_values(["a", "b"])
        found = leiden(rows)
        yield pd.DataFrame({"id": list(found), "community": list(found.values())}, dtype="int64")

    return merged.coalesce(1).mapInPandas(solve, "id bigint, community bigint")
