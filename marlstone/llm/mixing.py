"""Mixing sources to target weights by Pfair scheduling.

The mixture is as large as the target shares allow without using any document more than its source's ``repeats``.
A source of weight w is due w tokens of every token of the mixture. Its documents are its blocks: one that begins
after ``start`` tokens of the source may not come before ``start / w`` tokens of the mixture and must be done by
``(start + tokens) / w``. Of the documents that may come, the one of the earliest deadline does, so that every source
stays within about a document of its share of what has gone before.

Release and deadline follow from the place of a document in its source alone. So the mixture is cut into slices of
equal length, each document lies in the slice of the middle of its window, and the slices are scheduled apart, each
from the place in the mixture where it begins. There are as many slices as documents ask for; nothing is planned on
the driver. The place of a document in its source is a running sum in an order by hash, made in as many buckets as
the largest source asks for, so a source of a third of all rows is spread over as many tasks.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a slice and of a bucket, about.
SLICE = 20_000


def interleave(queues: dict, at: float = 0) -> Iterator[tuple]:
    """``(source, item)`` by earliest deadline first, of queues of ``(release, deadline, size, item)``.

    ``at`` is the place in the mixture where it begins. Where nothing may come yet, the next to be released does.
    """
    queues = {s: iter(q) for s, q in queues.items()}
    waiting: list = []
    ready: list = []

    def draw(source) -> None:
        for release, deadline, size, item in itertools.islice(queues[source], 1):
            heapq.heappush(waiting, (release, deadline, source, size, item))

    for source in queues:
        draw(source)
    while waiting or ready:
        while waiting and (waiting[0][0] <= at or not ready):
            release, *due = heapq.heappop(waiting)
            heapq.heappush(ready, tuple(due))
            if release > at:
                break
        _, source, size, item = heapq.heappop(ready)
        yield source, item
        at += size
        draw(source)


def pfair(weights: dict[str, float], slots: int) -> list[tuple[int, str, int]]:
    """``(slot, source, block of the source)`` for weights that sum to 1 and blocks of one slot each."""
    share = {s: Fraction(w).limit_denominator(1_000_000) for s, w in weights.items() if w > 0}
    total = sum(share.values())

    def windows(w: Fraction) -> Iterator[tuple]:
        return ((int(k // w), -(-(k + 1) // w), 1, k) for k in itertools.count())

    plan = interleave({s: windows(w / total) for s, w in share.items()})
    return [(slot, source, block) for slot, (source, block) in enumerate(itertools.islice(plan, slots))]


def placed(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs(id, source, tokens)`` with ``start``, the tokens of its source before it."""
    spot = docs.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sums = spot.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = sums.select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("base"))
    order = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("id", F.lit(1)), "id")
    inner = spot.withColumn("inside", F.sum("tokens").over(order) - F.col("tokens"))
    return inner.join(before, ["source", "bucket"]).select("id", "source", "tokens", (F.col("base") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, targets: list[tuple[str, float, int]], size: float | None = None, per_slice: int = SLICE) -> DataFrame:
    """The mixture of ``docs(id, source, tokens)``, one row per id, for ``(source, share, repeats)`` targets.

    A row per use of a document: ``slot, source, id, copy, start, tokens``; ordered by ``slot`` it
    is the interleaved stream. Documents of a null or unlisted source, or without tokens, are not used; a listed
    source without documents is left out and the other weights keep their proportions. ``size`` asks for a mixture
    of so many tokens; a source that can't reach its share of it within its repeats then gives all it may, and the
    shares reached fall short of the targets. A null or negative share
    counts as 0 and null repeats as 1. Nothing to mix gives no rows.
    """
    spark = docs.sparkSession
    wanted = {s: (float(w), int(r if r is not None else 1)) for s, w, r in targets if s is not None and w is not None and w > 0 and (r is None or r > 0)}
    usable = docs.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0)) if wanted else docs.limit(0)
    sums = usable.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()  # a row per target
    have = {r.source: int(r.t) for r in sums}
    weight = sum(wanted[s][0] for s in have)
    most = {s: float(have[s] * wanted[s][1]) for s in have}
    size = min((most[s] * weight / wanted[s][0] for s in have), default=0.0) if size is None else size
    quotas = {s: min(size * wanted[s][0] / weight, most[s]) for s in have}
    size = sum(quotas.values())
    uses = sum(r.n * quotas[r.source] / have[r.source] for r in sums)
    slices = max(1, -(-int(uses) // per_slice))
    quota = spark.createDataFrame([(s, quotas[s], have[s], wanted[s][1]) for s in have], "source string, quota double, total bigint, repeats int")
    spots = placed(usable, max([-(-r.n // per_slice) for r in sums], default=1))
    used = spots.join(F.broadcast(quota), "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    used = used.withColumn("start", F.col("start") + F.col("copy") * F.col("total")).where(F.col("start") < F.col("quota"))
    middle = (F.col("start") + F.col("tokens") / 2) / F.col("quota")
    used = used.withColumn("slice", F.least(F.floor(middle * slices), F.lit(slices - 1)).cast("int"))
    shares = {s: q / size for s, q in quotas.items()}

    def order(table: pa.Table) -> pa.Table:
        source, start, tokens = (table.column(c).to_pylist() for c in ("source", "start", "tokens"))
        part = table.column("slice")[0].as_py()
        queues: dict = {}
        for i in sorted(range(len(start)), key=start.__getitem__):
            w = shares[source[i]]
            queues.setdefault(source[i], []).append((start[i] / w, (start[i] + tokens[i]) / w, tokens[i], i))
        at = np.fromiter((i for _, i in interleave(queues, part * size / slices)), np.int64)
        out = table.take(pa.array(at)).select(["source", "id", "copy", "start", "tokens"])
        return out.add_column(0, "slot", pa.array((np.int64(part) << np.int64(32)) + np.arange(len(at))))

    rows = used.select("slice", "source", "id", "copy", "start", "tokens")
    return rows.groupBy("slice").applyInArrow(order, "slot bigint, source string, id bigint, copy int, start bigint, tokens bigint")


def share_report(mixed: DataFrame, targets: list[tuple[str, float, int]]) -> DataFrame:
    """Target and actual share of all tokens, tokens and uses of each target source."""
    wanted = mixed.sparkSession.createDataFrame([(s, w, r) for s, w, r in targets], "source string, target_share double, max_repeats int")
    sums = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.max("copy").alias("top"))
    out = wanted.join(sums, "source", "left").withColumn("all", F.sum("tokens").over(Window.partitionBy()))  # a row per target
    return out.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce(F.col("top") + 1, F.lit(0)).alias("repeats"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"))
