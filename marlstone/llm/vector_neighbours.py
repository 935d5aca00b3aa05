"""The most similar vectors of every vector by multi-index hashing.

A vector's code are the signs of its coordinates after a learned rotation: a rotation keeps all angles, so a sign
tells two vectors of angle t apart with probability t / pi however hot a topic is, and learning it (by turning a
sample so that its coordinates come near the corners of a cube) makes near vectors differ in fewer signs. Nothing is
centred or scaled. Where more bits are needed than there are dimensions, further rotations are learned.

The code is cut into substrings of ``length`` bits, each of which is an index, probed for all codes whose substring
is at most one bit off. Two codes that differ in fewer bits than twice the number of substrings meet in one of them
for certain (pigeonholes), farther ones with a probability, so there are as many substrings as it takes to miss a
pair at exactly ``least`` with a probability of at most ``missed``; nearer pairs are missed less. The length is the
one of the least modelled work for this number of vectors and the angles of a sample: the promise holds at every size
and only the work changes. Length 0 is one place that holds all: every pair is looked at and none is missed.

Probing sends no variants about. A substring that is at most one bit off agrees in one of its two halves for
certain, so each vector goes to one place per half; inside a place the other halves that are equal or one bit off are
found in a sorted array. What meets must have codes within the Hamming radius that a pair at ``least`` keeps but for
one in 10 000, and passes on only in the first substring it meets in, so that no pair comes twice. Then the vectors
themselves are compared.

A place of more than ``BLOCK`` vectors is cut into pairs of blocks that are worked on apart. Where more than
``DENSE`` codes lie within the radius of each on average, no pairs are passed on: the block's vectors are compared by
products, of which each vector keeps its best. A topic whose members are all about ``least`` from each other takes
work quadratic in its size, as nothing tells its nearest from the others before they are compared. Indexes are
exchanged ``ROUND`` halves at a time, which bounds the disk.

Equal vectors are one class, of which the lowest ids are neighbours of each other and of others' neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import dropped, written

#: Probability at which a pair of exactly the least cosine may be missed.
MISSED = 0.001
#: Vectors of each embedder that the rotation is learned from and the layout follows from; the work is theirs, never the recall.
SAMPLE, TURNS = 1_024, 5
#: Vectors of a block, rows of a product at once, vectors whose places are made at once, halves of an exchange.
BLOCK, STRIP, PART, ROUND = 4_096, 512, 1_000, 16
#: Modelled seconds of a vector in a half, and of a pair that meets.
ROW_S, PAIR_S = 1e-5, 2e-8
#: Codes within the radius of each vector of a place beyond which products replace pairs; pairs looked at together.
DENSE, CHUNK = 16, 1 << 14
#: Rows a task looks at together, and how far a product of 32-bit numbers may be off.
TOGETHER, SLACK = 20_000, 1e-5
#: Fewest bits of a code, and standard deviations of the bits that differ at the least cosine up to which codes are near.
LEAST_BITS, DEVIATIONS = 384, 4.2


def usable(df: DataFrame) -> DataFrame:
    """``(episode_id, embedder_id, vector)`` of vectors that count: of a known embedder, as long as ``dimensions``,
    without nulls and not all zero. Of repeated rows of an id one counts (the one of the greatest vector)."""
    good = F.col("episode_id").isNotNull() & F.col("embedder_id").isNotNull() & (F.size("vector") == F.col("dimensions"))
    good &= F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull())
    return df.where(good).groupBy("episode_id").agg(F.max(F.struct("embedder_id", "vector")).alias("r")).select("episode_id", "r.embedder_id", "r.vector")


def meets(same: np.ndarray | float, length: int) -> np.ndarray | float:
    """The probability that substrings of this length are at most one bit off, if bits are the same with probability ``same``."""
    return same**length + length * (1 - same) * same ** (length - 1) if length else same**0


def substrings_for(length: int, least: float, missed: float = MISSED) -> int:
    """How many substrings of this length miss a pair of cosine ``least`` with a probability of at most ``missed``."""
    if length == 0:
        return 1
    return int(np.ceil(np.log(missed) / np.log1p(-meets(1 - np.arccos(least) / np.pi, length))))


def layout(sample: np.ndarray, count: int, least: float, missed: float = MISSED) -> tuple[int, int]:
    """``(length, substrings)`` of the least modelled work for ``count`` vectors of which ``sample`` is one of rows."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    upper = np.triu_indices(len(unit), 1)
    same = 1 - np.arccos(np.clip((unit @ unit.T)[upper], -1, 1)) / np.pi if len(unit) > 1 else np.ones(1)
    best = (np.inf, 0, 1)
    for length in range(0, 42, 2):
        strings = substrings_for(length, least, missed)
        if strings >= 2_048:  # a place has twelve bits for its half
            break
        half = length // 2
        pairs = float((same**half * meets(same, half)).mean()) if length else 1.0
        rows = 2 * count if length else count * (1 + count / BLOCK)
        work = strings * (ROW_S * rows + PAIR_S * pairs * count**2)
        best = min(best, (work, length, strings))
    return best[1:]


def learned(sample: np.ndarray, bits: int, seed: int = 5) -> np.ndarray:
    """Directions of ``bits`` signs, a column each: rotations that bring the sample near the corners of a cube."""
    unit = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    rng, d = np.random.default_rng(seed), sample.shape[1]
    out = []
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
        for _ in range(TURNS):
            u, _, v = np.linalg.svd(unit.T @ np.where(unit @ turn > 0, 1, -1).astype(np.float32))
            turn = u @ v
        out.append(turn)
    return np.concatenate(out, axis=1)[:, :bits]


def radius(bits: int, least: float) -> int:
    """In how many of so many bits codes of vectors of cosine ``least`` differ at most, but for one in 70 000 (told by up to six words of them: one in 10 000)."""
    off = np.arccos(least) / np.pi
    return int(np.ceil(bits * off + DEVIATIONS * np.sqrt(bits * off * (1 - off))))


def _meeting(x: np.ndarray, y: np.ndarray, width: int, equal: bool, itself: bool):
    """Chunks ``(i, j)`` of the sorted keys ``x`` and ``y`` whose last ``width`` bits are one bit off, or none with ``equal``.

    With ``itself``, ``x`` is ``y`` and each pair comes once.
    """
    if not len(x):
        return
    for flip in [*([0] if equal else []), *(1 << np.arange(width, dtype=np.int64)).tolist()]:
        target = x ^ flip
        low, high = np.searchsorted(y, target, "left"), np.searchsorted(y, target, "right")
        if itself:
            low = np.arange(1, len(x) + 1) if not flip else np.where(target > x, low, high)
        counts = np.maximum(high - low, 0)
        ends = np.cumsum(counts)
        at = 0
        while at < len(x) and ends[-1] > (ends[at - 1] if at else 0):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
            own = counts[at:to]
            i = np.repeat(np.arange(at, to), own)
            j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + low[i]
            yield i, j
            at = to


def best_of(x: np.ndarray, y: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``x`` its ``k`` rows of ``y`` of another id with the greatest cosine of ``least`` or more, equal ones by lower id."""
    lengths = [np.sqrt((z.astype(np.float64) ** 2).sum(axis=1)) for z in (x, y)]
    units = [(z / n[:, None]).astype(np.float32) for z, n in zip((x, y), lengths, strict=True)]
    out = []
    for at in range(0, len(x), STRIP):
        s = units[0][at : at + STRIP] @ units[1].T
        floor = np.full(len(s), least)
        many = np.flatnonzero((s >= least - SLACK).sum(axis=1) > k + 1)  # one may be the vector itself
        if len(many):
            floor[many] = np.maximum(least, np.partition(s[many], -k - 1, axis=1)[:, -k - 1])
        who, other = np.nonzero(s >= (floor - SLACK)[:, None])
        who += at
        apart = x_ids[who] != y_ids[other]
        who, other = who[apart], other[apart]
        sim = np.empty(len(who))
        for i in range(0, len(who), BLOCK):
            a, b = who[i : i + BLOCK], other[i : i + BLOCK]
            sim[i : i + BLOCK] = (x[a].astype(np.float64) * y[b]).sum(axis=1) / (lengths[0][a] * lengths[1][b])
        good = np.flatnonzero(sim >= least - 1e-12)
        good = good[np.lexsort((y_ids[other[good]], -sim[good], who[good]))]
        starts = np.searchsorted(who[good], who[good], "left")
        good = good[np.arange(len(good)) - starts < k]
        out.append((x_ids[who[good]], y_ids[other[good]], sim[good]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _near(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose codes (a word of each per row of ``x`` and ``y``) lie within the radius, of one word, of two and so on."""
    off = np.zeros(len(i), np.uint16)
    for words, (one, two) in enumerate(zip(x, y, strict=True), 1):
        off += np.bitwise_count(one[i] ^ two[j])
        near = np.flatnonzero(off <= radius(64 * words, least))
        i, j, off = i[near], j[near], off[near]
    return i, j


def _first(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, length: int, strings: int, string: np.ndarray) -> np.ndarray:
    """Which pairs meet in no substring before ``string``."""
    off = np.unpackbits(np.ascontiguousarray((x[:, i] ^ y[:, j]).T).view(np.uint8), axis=1)[:, : length * strings].reshape(len(i), strings, length).sum(axis=2)
    return (off <= 1).argmax(axis=1) == string


def _met(table: pa.Table, layouts: list[tuple[int, int]], least: float) -> pa.Table:
    """``(a, b)`` of the near codes of each place, or ``(a, unit, right)``, a row per vector, of a dense one."""
    table = table.combine_chunks()
    place, pair, right, ids = (table.column(c).to_numpy(zero_copy_only=False) for c in ("place", "pair", "right", "id"))
    out_a, out_b, dense = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    kinds = place >> 44
    for kind in np.unique(kinds):
        length, strings = layouts[kind]
        rows = np.flatnonzero(kinds == kind)
        codes = np.frombuffer(b"".join(table.column("code").take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1)
        half = length // 2
        table_no = (place[rows] >> 32) & 4095
        string, second = table_no // 2, table_no % 2
        if length:
            bits = np.unpackbits(codes.view(np.uint8), axis=1)
            at = (string * length + np.where(second, 0, half))[:, None] + np.arange(half)
            other = np.take_along_axis(bits, at, axis=1) @ (1 << np.arange(half, dtype=np.int64))
        else:
            other = np.zeros(len(rows), np.int64)
        order = np.lexsort((other, right[rows], pair[rows], place[rows]))
        rows, codes, other, string, second = rows[order], codes[order], other[order], string[order], second[order]
        words = np.ascontiguousarray(codes.T)
        p, q, r = place[rows], pair[rows], right[rows]
        starts = np.flatnonzero(np.r_[True, (np.diff(p) != 0) | (np.diff(q) != 0)])
        ends = np.r_[starts[1:], len(rows)]

        def found(i, j, x, y, base_i, base_j, string=string, length=length, strings=strings):
            i, j = _near(x, y, i, j, least)
            if length and len(i):
                keep = _first(x, y, i, j, length, strings, string[base_i + i])
                i, j = i[keep], j[keep]
            return base_i + i, base_j + j

        small = []
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            cut = lo + int((~r[lo:hi]).sum())
            if hi - lo < 2 or cut == lo:  # alone, or without the block that it is paired with
                continue
            if cut == hi and hi - lo <= 64:
                small.append((lo, hi))
                continue
            i0, i1, j0, j1 = (lo, hi, lo, hi) if cut == hi else (lo, cut, cut, hi)
            got, count, crowd = [], 0, False
            for i, j in _meeting(other[i0:i1], other[j0:j1], half, not second[lo], cut == hi):
                i, j = found(i, j, words[:, i0:i1], words[:, j0:j1], i0, j0)
                got.append((i, j))
                count += len(i)
                if count > DENSE * (hi - lo):
                    crowd = True
                    break
            if crowd:
                dense.append((rows[lo:hi], np.int64(hash((int(p[lo]), int(q[lo])))), r[lo:hi]))
            else:
                for i, j in got:
                    out_a.append(ids[rows[i]])
                    out_b.append(ids[rows[j]])
        if small:  # at most 32 pairs a vector: all such places at once
            at = np.concatenate([np.arange(lo, hi) for lo, hi in small])
            number = np.repeat(np.arange(len(small)), [hi - lo for lo, hi in small])
            for part in (0, 1):
                mine = second[at] == part
                x = at[mine]
                key = (number[mine] << half) | other[x]
                for i, j in _meeting(key, key, half, not part, True):
                    i, j = x[i], x[j]
                    i, j = found(i, j, words, words, 0, 0)
                    out_a.append(ids[rows[i]])
                    out_b.append(ids[rows[j]])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    crowded = np.concatenate([d[0] for d in dense]) if dense else np.zeros(0, np.int64)
    units = np.concatenate([np.full(len(d[0]), d[1]) for d in dense]) if dense else np.zeros(0, np.int64)
    sides = np.concatenate([d[2] for d in dense]) if dense else np.zeros(0, bool)
    none = len(crowded)
    return pa.table({
        "a": np.r_[np.minimum(a, b), ids[crowded]], "b": pa.chunked_array([pa.array(np.maximum(a, b)), pa.nulls(none, pa.int64())]),
        "unit": pa.chunked_array([pa.nulls(len(a), pa.int64()), pa.array(units)]), "right": pa.chunked_array([pa.nulls(len(a), pa.bool_()), pa.array(sides)]),
    })


def neighbours(df: DataFrame, k: int = 5, least: float = 0.8, missed: float = MISSED) -> DataFrame:
    """``(episode_id, neighbour_id, similarity, place)``: of each usable vector the up to ``k`` others of its embedder
    with the greatest cosine of ``least`` or more, equal cosines by lower id. Without usable vectors no rows."""
    spark = df.sparkSession
    vectors = written(usable(df), "vectors")
    classes = vectors.groupBy("embedder_id", "vector").agg(F.min("episode_id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    kinds = [(r.embedder_id, r.d, r.n) for r in classes.groupBy("embedder_id", F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()]  # a row per model
    kinds.sort()
    layouts, turns = [], []
    for embedder, dimensions, count in kinds:
        rows = classes.where((F.col("embedder_id") == embedder) & (F.size("vector") == dimensions)).orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").toPandas()
        sample = np.array(rows["vector"].tolist(), np.float32)
        layouts.append(layout(sample, count, least, missed))
        turns.append(learned(sample, max(LEAST_BITS, -(-layouts[-1][0] * layouts[-1][1] // 64) * 64)))
    marks = {(e, d): i for i, (e, d, _) in enumerate(kinds)}
    rotations = spark.sparkContext.broadcast(turns)
    kind_of = np.dtype({"byte": "i1", "float": "f4"}.get(df.schema["vector"].dataType.elementType.typeName(), "f8"))

    def coded(batches):
        for batch in batches:
            ids, embedders, vecs = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            groups: dict = {}
            for i, key in enumerate(zip(embedders, np.asarray(pa.compute.list_value_length(vecs)).tolist(), strict=True)):
                groups.setdefault(marks[key], []).append(i)
            for kind, at in ((kind, at[i : i + PART]) for kind, at in groups.items() for i in range(0, len(at), PART)):
                raw = vecs.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1).astype(kind_of)
                code = np.packbits(raw.astype(np.float32) @ rotations.value[kind] > 0, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), kind, np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "kind", "code"])

    codes = written(classes.select("id", "embedder_id", "vector").mapInArrow(coded, "id bigint, kind int, code binary"), "codes")

    def places(batches, first: int, last: int):
        """``(ids, codes, vectors x places)`` of each kind that has any of the halves ``first`` to ``last``."""
        for batch in batches:
            ids, own_kind, code = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for kind in np.unique(own_kind).tolist():
                length, strings = layouts[kind]
                own = np.arange(first, min(last, 2 * strings if length else 1))
                if not len(own):
                    continue
                at, half = np.flatnonzero(own_kind == kind), length // 2
                packed = code.take(pa.array(at))
                bits = np.unpackbits(np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(at), -1), axis=1)
                value = bits[:, first * half : (first + len(own)) * half].reshape(len(at), len(own), half) @ (1 << np.arange(half, dtype=np.int64))
                yield ids[at], packed, value + (own << 32) + (kind << 44)

    last = max((2 * strings if length else 1 for length, strings in layouts), default=0)

    def counted(batches):
        for _, _, value in places(batches, 0, last):
            place, count = np.unique(value, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(count)], ["place", "count"])

    crowds = codes.mapInArrow(counted, "place bigint, count bigint").groupBy("place").agg(F.sum("count").alias("count")).where(F.col("count") > BLOCK).orderBy("place").collect()  # at most one of BLOCK places of vectors
    crowded = spark.sparkContext.broadcast((np.array([r["place"] for r in crowds], np.int64), np.array([-(-r["count"] // BLOCK) for r in crowds], np.int64)))
    more = sum(r["count"] * -(-r["count"] // BLOCK) for r in crowds)

    def dealt(batches, first: int, groups: int):
        """Each vector at each of its places, at a crowded one with every block that its own is paired with."""
        big, parts = crowded.value
        for ids, code, value in places(batches, first, first + ROUND):
            own = np.tile(np.arange(len(ids))[:, None], value.shape[1]).reshape(-1)
            place = value.reshape(-1)
            blocks = np.ones(len(place), np.int64)
            if len(big):
                at = np.minimum(np.searchsorted(big, place), len(big) - 1)
                blocks = np.where(big[at] == place, parts[at], 1)
            with np.errstate(over="ignore"):
                mixed = (ids[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = (mixed % blocks.astype(np.uint64)).astype(np.int64)
            who = np.repeat(np.arange(len(place)), blocks)
            other = np.arange(len(who)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            mine = block[who]
            pair = np.minimum(mine, other) * blocks[who] + np.maximum(mine, other)
            with np.errstate(over="ignore"):
                group = ((((place[who] + pair * 1_000_003).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(groups)
            for i in range(0, len(who), 10 * PART):
                cut = slice(i, i + 10 * PART)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[cut].astype(np.int32)), pa.array(place[who[cut]]), pa.array(pair[cut]), pa.array(mine[cut] > other[cut]), pa.array(ids[own[who[cut]]]), code.take(pa.array(own[who[cut]]))],
                    ["deal", "place", "pair", "right", "id", "code"],
                )

    total, found = sum(n for *_, n in kinds), []
    for first in range(0, last, ROUND):
        rows_out = total * min(ROUND, last - first) + (more if last <= ROUND else more * ROUND // last)
        groups = max(spark.sparkContext.defaultParallelism * 3, -(-rows_out // TOGETHER))
        rows = codes.mapInArrow(lambda b, f=first, g=groups: dealt(b, f, g), "deal int, place bigint, pair bigint, right boolean, id bigint, code binary")
        found.append(written(rows.repartition(groups, "deal").groupBy("deal").applyInArrow(lambda t: _met(t, layouts, least), "a bigint, b bigint, unit bigint, right boolean"), "met"))
        spark._jvm.System.gc()  # noqa: SLF001 - the round's shuffle files go with its plan
    met = spark.createDataFrame([], "a bigint, b bigint, unit bigint, right boolean")
    for part in found:
        met = met.unionByName(part)
    own = classes.select(F.col("id"), "vector")

    def exact(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in (0, 1))
            sizes = np.asarray(pa.compute.list_value_length(batch.column(2)))
            for size in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == size))
                x, y = (batch.column(c).take(at).flatten().to_numpy().reshape(len(at), -1).astype(np.float64) for c in (2, 3))
                similarity = (x * y).sum(axis=1) / (np.sqrt((x**2).sum(axis=1)) * np.sqrt((y**2).sum(axis=1)))
                keep = similarity >= least - 1e-12
                yield pa.RecordBatch.from_arrays([pa.array(a[at.to_numpy()][keep]), pa.array(b[at.to_numpy()][keep]), pa.array(similarity[keep])], ["a", "b", "similarity"])

    near = met.where("b is not null").select("a", "b").join(own.toDF("a", "va"), "a").join(own.toDF("b", "vb"), "b").select("a", "b", "va", "vb").mapInArrow(exact, "a bigint, b bigint, similarity double")

    def compared(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        right, ids = (table.column(c).to_numpy(zero_copy_only=False) for c in ("right", "id"))
        x = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(kind_of)
        if not right.any():
            sides = [(x, x, ids, ids)]
        else:
            one, two = (x[~right], ids[~right]), (x[right], ids[right])
            sides = [(one[0], two[0], one[1], two[1]), (two[0], one[0], two[1], one[1])]
        a, b, similarity = (np.concatenate(c) for c in zip(*[best_of(*side, k + 1, least) for side in sides], strict=True))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": similarity})

    dense = met.where("unit is not null").select("unit", "right", F.col("a").alias("id")).join(own, "id")
    best = dense.groupBy("unit").applyInArrow(compared, "a bigint, b bigint, similarity double")
    links = written(near.unionByName(best).groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "links")
    dropped(spark, *found, codes)
    # The k + 1 lowest ids of a class are all that can be among anyone's k neighbours.
    home = vectors.join(classes.where("copies > 1").select("embedder_id", "vector", F.col("id").alias("class")), ["embedder_id", "vector"], "inner").select("episode_id", "class")
    lowest = home.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("episode_id"))).where(F.col("n") <= k + 1).select("class", F.col("episode_id").alias("neighbour_id"))
    alone = classes.where("copies = 1").select(F.col("id").alias("class"), F.col("id").alias("neighbour_id"))
    members = home.unionByName(alone.select(F.col("neighbour_id").alias("episode_id"), "class"))
    targets = lowest.unionByName(alone)
    directed = links.select(F.col("a").alias("class"), F.col("b").alias("other"), "similarity").unionByName(links.select(F.col("b").alias("class"), F.col("a").alias("other"), "similarity"))
    own = classes.where("copies > 1").select(F.col("id").alias("class"), F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    reach = directed.unionByName(own).join(targets.withColumnRenamed("class", "other"), "other").select("class", "neighbour_id", "similarity")
    best = Window.partitionBy("class").orderBy(F.desc("similarity"), "neighbour_id")
    short = reach.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    full = members.join(short, "class").where("episode_id <> neighbour_id")
    order = Window.partitionBy("episode_id").orderBy(F.desc("similarity"), "neighbour_id")
    return full.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("episode_id", "neighbour_id", "similarity", "place")


def pairs(found: DataFrame) -> DataFrame:
    """``(episode_a, episode_b)``, a < b, of vectors of which one is a neighbour of the other."""
    return found.select(F.least("episode_id", "neighbour_id").alias("episode_a"), F.greatest("episode_id", "neighbour_id").alias("episode_b")).distinct()
