"""Filling fixed-capacity containers with items by best-two-fit.

Items are dealt by a hash of their id into blocks of about ``block_items``, each packed by one task: a block is
bounded however large the collection or any group in it is, and the last, poorly filled container of a block is
the only loss against packing everything at once.

In a block, a container is filled greedily, the largest item that fits first. Then its smallest item is taken out
again if two items not yet packed fill the widened gap more tightly. An item larger than the capacity, and no
other, is split: into containers of exactly the capacity and a rest that is packed like any item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import written

BLOCK_ITEMS = 20_000


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item of size 1 to ``capacity``, numbered from 0."""
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    distinct, first, count = np.unique(ordered, return_index=True, return_counts=True)
    left = count.copy()
    home = np.full(len(sizes), -1, np.int64)
    alive, values = np.arange(len(distinct)), distinct
    box = 0

    def take(d: int) -> int:
        left[d] -= 1
        return int(order[first[d] + left[d]])

    remaining = len(sizes)
    while remaining:
        gap, inside = capacity, []
        while gap:
            at = int(np.searchsorted(values, gap, "right")) - 1
            while at >= 0 and not left[alive[at]]:
                at -= 1
            if at < 0:
                break
            d = int(alive[at])
            inside.append((d, take(d)))
            gap -= int(distinct[d])
        if gap:
            live = left[alive] > 0
            if not live.all():
                alive, values = alive[live], values[live]
            small = int(distinct[inside[-1][0]])
            wide = gap + small
            fits = values[: np.searchsorted(values, wide, "right")]
            if len(fits) and len(inside) > 0:
                mate = np.searchsorted(values, wide - fits, "right") - 1
                same = (mate == np.arange(len(fits))) & (left[alive[: len(fits)]] < 2)
                mate = np.where(same, mate - 1, mate)
                total = np.where(mate >= 0, fits + values[np.maximum(mate, 0)], 0)
                best = int(total.argmax())
                if total[best] > small:
                    d, _ = inside.pop()  # its size's places are a stack, so it is on top again
                    left[d] += 1
                    for e in (int(alive[best]), int(alive[mate[best]])):
                        inside.append((e, take(e)))
                    if not np.any(alive == d):
                        at = int(np.searchsorted(values, distinct[d]))
                        alive, values = np.insert(alive, at, d), np.insert(values, at, distinct[d])
        for _, item in inside:
            home[item] = box
        remaining -= len(inside)
        box += 1
    return home


def pack(sizes: DataFrame, capacities: list[tuple[str, int]], block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Pack ``sizes(id, tokens)``, one row per id, for every ``(name, capacity)``.

    A row per piece: ``capacity_name, capacity_tokens, id, piece, pieces, tokens, bin``; ``pieces`` is 1 unless
    the item had to be split. An item of size 0 or null takes no room and lies in its block's first container.
    The capacities are a table of parameters (a few rows); they must be positive. Empty input gives no rows.
    """
    blocks = max(1, -(-sizes.count() // block_items))
    dealt = sizes.select("id", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(int(c)).cast("bigint").alias("tokens")) for n, c in capacities]))
    work = dealt.withColumn("to", each).select("id", "tokens", "block", F.col("to.name").alias("capacity_name"), F.col("to.tokens").alias("capacity_tokens"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        capacity, block = int(frame.capacity_tokens.iloc[0]), int(frame.block.iloc[0])
        frame = frame.sort_values("id", ignore_index=True)
        full, rest = np.divmod(frame.tokens.to_numpy(), capacity)
        pieces = np.maximum(full + (rest > 0), 1)
        row = np.repeat(np.arange(len(frame)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        tokens = np.where(piece < full[row], capacity, rest[row])
        home = np.zeros(len(row), np.int64)
        whole, part = tokens == capacity, (tokens > 0) & (tokens < capacity)
        home[part] = best_two_fit(tokens[part], capacity)
        used = int(home[part].max()) + 1 if part.any() else 0
        home[whole] = used + np.arange(int(whole.sum()))
        return pd.DataFrame({
            "capacity_name": frame.capacity_name.iloc[0], "capacity_tokens": capacity, "id": frame.id.to_numpy()[row], "piece": piece,
            "pieces": pieces[row], "tokens": tokens, "bin": (np.int64(block) << np.int64(32)) + home,
        })

    return work.groupBy("block", "capacity_name", "capacity_tokens").applyInPandas(fill, "capacity_name string, capacity_tokens bigint, id bigint, piece bigint, pieces bigint, tokens bigint, bin bigint")


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, items split, tokens and the share of room used, per capacity."""
    boxes = packed.groupBy("capacity_name", "capacity_tokens", "bin").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = boxes.groupBy("capacity_name", "capacity_tokens").agg(F.count("*").alias("bins"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"))
    return total.withColumn("used_share", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")))


def kept_sizes(sizes: DataFrame) -> DataFrame:
    """The sizes as a table in the shared folder, so that they are counted and packed without being made again."""
    return written(sizes, "sizes")
