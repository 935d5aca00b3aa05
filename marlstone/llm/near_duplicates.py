"""Near-duplicate records by min-hash signatures.

A record is its set of words. Its sketch is a row of min-hash symbols of all its words, cut into segments; each
segment is a signature, and an equality join on signatures finds all pairs that have a segment in common. What is
found is verified on the word sets.

The similarity that is asked for counts all words, so the sketch does too: with words left out for being common, a
pair whose edits fall on the others would be sought at a much lower similarity than it has. Two records of
similarity J meet in a segment of q symbols with J^q, whatever their words are; there are as many segments as it
takes to miss a pair of exactly ``threshold`` with a probability of ``MISSED``: 5e-3 at 0.6, 1e-6 at 0.7. As common
words make unrelated records meet, a segment gets a symbol more with each fourfold number of records.

Records of the same words are one class. A task signs a set of words only the first time it sees it, so that any
number of copies gives at most a signature set per task. Signatures travel packed, a row for each bucket of a batch
and not a row each, and are sorted a bucket at a time; there are as many buckets as keep one at ``BUCKET`` signatures.
A run of equal signatures longer than ``RUN`` is not paired where it lies, nor held; its members are reduced to
one per class and paired by a join on the signature, which Spark splits where it is skewed. Before words are
compared, candidates must agree in 9 of 32 four-bit min-hashes, which a pair of similarity 0.6 misses once in
100 000 times.

Signatures are as wide as the number of rows needs for an accidental meeting to stay rarer than one in sixteen.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import dropped, written

WORD = re.compile("[a-z0-9]+")
#: Symbols of a segment of up to so many records, and the probability at which a pair of exactly the threshold may be missed.
SYMBOLS, UP_TO, MISSED = 6, 250_000, 0.005
#: The longest run of equal signatures that is paired where it lies; the digests a task remembers.
RUN, SEEN = 512, 1_000_000
#: Records that are signed together, and packed together (16 bits number them); signatures of a bucket, and packed together.
TOGETHER, PACKED, BUCKET, AT_ONCE = 1_000, 10_000, 1_500_000, 4_000_000
#: One-bit min-hashes of 128 in which candidates must agree before their words are compared.
AGREE = 83


class NearDuplicates(NamedTuple):
    """``members(id, class_id)``, one row per record; ``links(class_a, class_b, similarity)``, class_a < class_b."""

    members: DataFrame
    links: DataFrame


class _Hashes(dict):
    """The hash of each word, made when it is first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh32_intdigest(word) - 2**31
        return value


def word_sets(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(id, digest, s1, s2, words)``: of the distinct words of ``columns`` joined by spaces, the sorted 32-bit
    hashes, their digest and 128 one-bit min-hashes.

    Null columns are empty. A record without a word has an empty array.
    """
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])

    def split(batches):
        hashed = _Hashes()
        for batch in batches:
            digests, words = [], []
            if len(hashed) > 500_000:
                hashed.clear()
            for t in batch.column(1).to_pylist():
                own = set(map(hashed.__getitem__, set(WORD.findall(t.lower()))))
                array = np.sort(np.fromiter(own, np.int32, len(own)))
                words.append(array)
                digests.append(xxhash.xxh128_digest(array.tobytes()))
            flat = np.concatenate(words) if words else np.zeros(0, np.int32)
            ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
            first, second = min_bits(words)
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(first), pa.array(second), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "s1", "s2", "words"])

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), text.alias("t")).mapInArrow(split, "id bigint, digest binary, s1 bigint, s2 bigint, words array<int>")


def min_bits(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 one-bit min-hashes of each array of word hashes, in two 64-bit words; 0 of an empty one."""
    packed = np.zeros((2, len(words)), np.uint64)
    some = [i for i, w in enumerate(words) if len(w)]
    if some:
        flat = np.concatenate([words[i] for i in some]).astype(np.int64).view(np.uint64)
        starts = np.cumsum([0, *[len(words[i]) for i in some]][:-1])
        with np.errstate(over="ignore"):
            base = (_mix(flat + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)
            room = np.empty_like(base)
            for k in range(128):
                seed = (k + 1) * 0xA0761D6478BD642F % 2**64
                least = np.minimum.reduceat(_seeded(base, seed, room), starts)
                packed[k // 64, some] |= (_mix(least.astype(np.uint64)) & np.uint64(1)) << np.uint64(k % 64)
    return packed[0].view(np.int64), packed[1].view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def layout(records: int, threshold: float) -> tuple[int, int]:
    """``(symbols, segments)`` for so many records."""
    symbols = SYMBOLS + max(0, int(np.ceil(np.log2(max(1, records) / UP_TO) / 2)))
    return symbols, int(np.ceil(np.log(MISSED) / np.log1p(-(threshold**symbols))))


def signatures_of(words: list[np.ndarray], symbols: int, segments: int) -> np.ndarray:
    """A row of ``segments`` signatures for each (non-empty) array of word hashes."""
    if len(words) > TOGETHER:  # in parts that stay near the processor
        return np.concatenate([signatures_of(words[i : i + TOGETHER], symbols, segments) for i in range(0, len(words), TOGETHER)])
    flat = np.concatenate(words).astype(np.int64).view(np.uint64)
    starts = np.cumsum([0, *map(len, words)][:-1])
    out = np.zeros((segments, len(words)), np.uint64)
    with np.errstate(over="ignore"):
        base = (_mix(flat + np.uint64(1 << 20)) >> np.uint64(32)).astype(np.uint32)
        room = np.empty_like(base)
        for s in range(segments):
            for k in range(symbols):
                least = np.minimum.reduceat(_seeded(base, (s * symbols + k + 1) * 0xD6E8FEB86659FD93 % 2**64, room), starts)
                out[s] += _mix(least.astype(np.uint64) + np.uint64(k << 32))
            out[s] = _mix(out[s] + np.uint64(s))
    return np.ascontiguousarray(out.T)


def _seeded(base: np.ndarray, seed: int, room: np.ndarray) -> np.ndarray:
    """Another hash of each word from its first, made in ``room``."""
    np.bitwise_xor(base, np.uint32(seed >> 32), out=room)
    return np.multiply(room, np.uint32(seed & 0xFFFFFFFF | 1), out=room)


def near_duplicates(df: DataFrame, key: str, columns: list[str], threshold: float = 0.6) -> NearDuplicates:
    """Group records whose word sets have a Jaccard similarity of ``threshold`` or more.

    ``key`` is an integer id; rows of a null key are left out, repeated rows count once (of rows that repeat a key
    with another text, the one of the smaller digest). Records without any word are a class each: nothing is similar to them. An empty table gives empty results. A threshold below 0.6 would need
    a looser sketch test and is refused.
    """
    if threshold < 0.6:
        raise ValueError("the signatures are laid out for a similarity of 0.6 or more")
    sets = stored = written(word_sets(df, key, columns), "wordsets")
    total = sets.count()
    symbols, segments = layout(total, threshold)

    # Rows that repeat an id with other words: only those of the least digest stay.
    mixed = sets.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("id", "least")
    mixed = written(mixed, "mixed")
    sets = sets.join(mixed, "id", "left").where("least is null or least = digest").drop("least")

    owner = sets.where(F.size("words") > 0).groupBy("digest").agg(F.min("id").alias("class_id"))
    bits = min(64, max(32, int(np.ceil(np.log2(max(1, total) * segments))) + 3))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = tasks * int(np.ceil(max(8, total * segments / BUCKET) / tasks))

    def sign(batches):
        seen: set[bytes] = set()
        for batch in batches:
            fresh = []
            for i, d in enumerate(batch.column(1).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    fresh.append(i)
            if len(seen) > SEEN:
                seen.clear()
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            ids = batch.column(0).to_numpy()
            column = batch.column(2)
            flat, ends = column.flatten().to_numpy(), np.cumsum([0, *np.asarray(pa.compute.list_value_length(column))])
            full = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            records = np.stack([ids, batch.column(3).to_numpy(), batch.column(4).to_numpy()], axis=1)
            step = max(1, min(PACKED, AT_ONCE // segments))
            for i in range(0, len(full), step):
                rows = signatures_of(full[i : i + step], symbols, segments) >> np.uint64(64 - bits)
                yield _packed(rows, records[i : i + step], buckets, bits)

    signed = sets.where(F.size("words") > 0).select("id", "digest", "words", "s1", "s2").mapInArrow(sign, "bucket bigint, sigs binary, places binary, records binary")
    met = written(signed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket").mapInArrow(_runs, "a bigint, b bigint, sig bigint, s1 bigint, s2 bigint"), "met")
    crowd = met.where("b is null").select("sig", F.col("a").alias("id"), "s1", "s2")
    parts = crowd.groupBy("sig").agg(F.ceil(F.count("*") / RUN).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id"), "parts").cast("int")
    blocks = crowd.join(parts, "sig").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("sig", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("pair"), (F.col("own") > F.col("other")).alias("right"), "id", "s1", "s2")
    crossed = blocks.groupBy("sig", "pair").applyInArrow(_blocks, "a bigint, b bigint")
    pairs = written(met.where("b is not null").select("a", "b").unionByName(crossed).distinct(), "candidates")
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    words = sets.join(needed, "id", "left_semi").dropDuplicates(["id"])
    both = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    close = both.select("a", "b", (shared / (F.size("wa") + F.size("wb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)
    records = sets.groupBy("id").agg(F.min("digest").alias("digest"))
    members = written(records.join(owner, "digest", "left").select("id", F.coalesce("class_id", "id").alias("class_id")), "members")
    owned = close.join(members.toDF("a", "ca"), "a").join(members.toDF("b", "cb"), "b").where("ca <> cb")
    links = owned.select(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b"), "similarity").distinct()
    links = written(links, "links")
    dropped(df.sparkSession, stored, met, mixed, pairs)
    return NearDuplicates(members, links)


def _near(s1: np.ndarray, s2: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows agree in ``AGREE`` one-bit min-hashes or more."""
    off = np.bitwise_count((s1[i] ^ s1[j]).view(np.uint64)) + np.bitwise_count((s2[i] ^ s2[j]).view(np.uint64))  # of signed numbers it would count the magnitude's
    return off <= 128 - AGREE


def _ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct pairs of different ids, the lower first."""
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b]
    pairs = pairs[:, np.lexsort(pairs[::-1])]
    return pairs[:, np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)][: pairs.shape[1]]]


def _packed(rows: np.ndarray, records: np.ndarray, buckets: int, bits: int) -> pa.RecordBatch:
    """A row for each bucket of the signatures ``rows`` (``bits`` wide, a row for each record): the lower halves of its
    signatures, the place of the record of each, and the records ``(id, s1, s2)`` that have any.

    Buckets are ranges of signatures no wider than 32 bits, so in a bucket the lower half tells a signature.
    """
    flat = rows.reshape(-1)
    bucket = (flat * np.uint64(buckets)) >> np.uint64(bits)
    bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, owner = bucket[order], order // rows.shape[1]
    begins = np.r_[True, bucket[1:] != bucket[:-1]]
    fresh = begins.copy()
    fresh[1:] |= owner[1:] != owner[:-1]
    starts, number = np.flatnonzero(begins), np.cumsum(fresh) - 1
    sizes = np.diff(np.r_[starts, len(flat)])
    places = (number - np.repeat(number[starts], sizes)).astype(np.uint16)

    def cut(array: np.ndarray, at: np.ndarray, each: int) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.r_[at, len(array)] * each).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(array))])

    columns = [pa.array(bucket[starts].astype(np.int64)), cut(flat[order].astype(np.uint32), starts, 4), cut(places, starts, 2), cut(records[owner[fresh]], number[starts], 24)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "sigs", "places", "records"])


def _runs(batches):
    """Near pairs ``(a, b)`` of each run of equal signatures, or its members ``(a, null, sig, s1, s2)`` if it is long.

    The rows of :func:`_packed` come sorted by bucket.
    """
    names = ["a", "b", "sig", "s1", "s2"]

    def crowded(bucket, sig, rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.nulls(len(rows), pa.int64()), pa.array(sig.astype(np.int64) + (bucket << 32)), pa.array(rows[:, 1]), pa.array(rows[:, 2])], names)

    def met(parts):
        """Signatures that occur more than once, in order, their rows ``(id, s1, s2)``, their places in the run and its size."""
        before = np.cumsum([0, *[len(r) for _, _, r in parts]])
        sig, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + n for p, n in zip(parts, before[:-1], strict=True)])
        key = np.sort(sig.astype(np.uint64) << np.uint64(32) | np.arange(len(sig), dtype=np.uint64))
        sig = (key >> np.uint64(32)).astype(np.uint32)
        same = sig[1:] == sig[:-1]
        more = np.r_[False, same] | np.r_[same, False]
        sig, place = sig[more], place[(key[more] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
        sizes = np.diff(np.r_[starts, len(sig)])
        return sig, np.concatenate([r for _, _, r in parts])[place], np.arange(len(sig)) - np.repeat(starts, sizes), np.repeat(sizes, sizes)

    def paired(bucket, parts):
        sig, rows, _, sizes = met(parts)
        long = sizes > RUN
        if long.any():
            yield crowded(bucket, sig[long], rows[long])
            sig, rows = sig[~long], rows[~long]
        ids, s1, s2 = (np.ascontiguousarray(rows[:, c]) for c in range(3))
        lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        k, step = np.arange(len(sig)), 1
        while len(k):  # each row with the one so many rows on, as long as that is of the same run
            k = k[k + step < len(sig)]
            k = k[sig[k] == sig[k + step]]
            near = k[_near(s1, s2, k, k + step)]
            lefts.append(ids[near])
            rights.append(ids[near + step])
            step += 1
        apart = _ordered(np.concatenate(lefts), np.concatenate(rights))
        none = pa.nulls(apart.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(apart[0]), pa.array(apart[1]), none, none, none], names)

    bucket, parts, held, most = None, [], 0, 4 * BUCKET
    for batch in batches:
        for other, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if parts and other != bucket:
                yield from paired(bucket, parts)
                parts, held, most = [], 0, 4 * BUCKET
            bucket = other
            sigs, places, records = (np.frombuffer(p, kind) for p, kind in zip(packed, (np.uint32, np.uint16, np.int64), strict=True))
            parts.append((sigs, places.astype(np.int64), records.reshape(-1, 3)))
            held += len(sigs)
            if held > most:  # surely crowds: pass on what there is of them, but for enough to know them by
                sig, rows, nth, sizes = met(parts)
                gone = (sizes > 8 * RUN) & (nth >= 2 * RUN)
                if gone.any():
                    yield crowded(bucket, sig[gone], rows[gone])
                    crowds = np.unique(sig[gone])
                    rest = [~np.isin(p[0], crowds) for p in parts]
                    kept = np.isin(sig, crowds) & ~gone
                    parts = [(p[0][r], p[1][r], p[2]) for p, r in zip(parts, rest, strict=True)]
                    parts.append((sig[kept], np.arange(kept.sum()), rows[kept]))
                held = sum(len(p[0]) for p in parts)
                most = max(4 * BUCKET, 2 * held)
    if parts:
        yield from paired(bucket, parts)


def _blocks(table: pa.Table) -> pa.Table:
    """The near pairs of two blocks of a crowd, or within one."""
    right, ids, s1, s2 = (table.column(c).to_numpy() for c in ("right", "id", "s1", "s2"))
    one, two = (np.flatnonzero(~right), np.flatnonzero(right)) if right.any() else (np.arange(len(ids)),) * 2
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in one:
        near = two[_near(s1, s2, np.full(len(two), i), two)]
        lefts.append(np.full(len(near), ids[i]))
        rights.append(ids[near])
    a, b = _ordered(np.concatenate(lefts), np.concatenate(rights))
    return pa.table({"a": a, "b": b})


def all_pairs(found: NearDuplicates) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b, of all near-duplicate records, copies included."""
    member = found.members
    one = member.select("class_id", F.col("id").alias("x"))
    two = member.select("class_id", F.col("id").alias("y"))
    sized = member.groupBy("class_id").count().where("count > 1").select("class_id")
    copies = one.join(sized, "class_id", "left_semi").join(two, "class_id").where("x < y").select("x", "y")
    apart = found.links.join(one.withColumnRenamed("class_id", "class_a"), "class_a").join(two.withColumnRenamed("class_id", "class_b"), "class_b").select("x", "y")
    return copies.unionByName(apart).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def grouped(found: NearDuplicates) -> DataFrame:
    """``(id, class_id, copies, links)``: a row per record with its class, its size and the number of its links."""
    sides = found.links.select(F.col("class_a").alias("class_id")).unionByName(found.links.select(F.col("class_b").alias("class_id")))
    counts = found.members.groupBy("class_id").agg(F.count("*").alias("copies")).join(sides.groupBy("class_id").agg(F.count("*").alias("links")), "class_id", "left")
    return found.members.join(counts, "class_id").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
