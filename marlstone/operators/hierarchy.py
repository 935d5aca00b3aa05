"""Parent links to full hierarchies by tree contraction.

Each round rakes leaves off the forest and compresses unary chains; what is removed is recorded as a link to a
node that outlives it. Trees shrink to their root in a logarithmic number of rounds however deep they are, and a
loop shrinks to one node that is its own parent, the core that no further round can remove. The recorded links
form a forest whose height is at most the number of rounds, so a few pointer doublings give every node its root,
depth and path.

A round moves two small messages per live node: children report to their parent as pre-aggregated counts (so a
parent of a third of all rows costs one row per map task), and a compressed node tells its only child its new
parent. Nothing is collected; each round's state is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import dropped, written

#: A forest of n nodes needs about 1.7 * log2(n) rounds; more than this is a defect, not a deeper tree.
MAX_ROUNDS = 400


def parent_links(df: DataFrame, node: str, parent: str, prefer: list | None = None) -> DataFrame:
    """One ``(id, parent)`` row per node.

    ``prefer`` orders repeated rows of a node, the greatest wins; without it the greatest parent does. Rows with
    a null or empty node are left out. A parent that is null, empty or all zeros becomes null.
    """
    up = F.col(parent)
    blank = up.isNull() | F.trim(up).rlike("^0*$")
    rows = df.where(F.col(node).isNotNull() & (F.col(node) != "")).select(
        F.col(node).alias("id"), F.when(~blank, up).alias("parent"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(prefer or [])]
    )
    order = F.struct(*[f"_by{i}" for i in range(len(prefer or []))], "parent")
    return rows.groupBy("id").agg(F.max(order)["parent"].alias("parent"))


def resolve(links: DataFrame, with_paths: bool = False) -> DataFrame:
    """``(id, root, depth, cyclic[, path])`` for each row of ``links(id, parent)``.

    ``id`` must be unique. A node without a parent, or whose parent is no node, is a root of depth 0. A node whose
    chain of parents runs into a loop is ``cyclic`` and has no root, depth or path. ``path`` lists the ids from
    the root to the node. An empty table gives an empty result.
    """
    spark = links.sparkSession
    known = links.select(F.col("id").alias("_known"))
    start = links.join(known, links.parent == known._known, "left").select(
        "id", F.col("_known").alias("parent"), F.lit(1).cast("bigint").alias("w"), *([F.array("id").alias("seg")] if with_paths else [])
    )
    live, removed = start, []
    for rnd in range(MAX_ROUNDS):
        state, left = written(_round(live, rnd, with_paths), "contract", {"left": F.col("fate").isin("kept", "compressed")})
        removed.append(state)
        if not left["left"]:
            break
        live = _next(state, with_paths)
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds of contraction")
    gone = removed[0].where(F.col("fate") != "kept")
    for state in removed[1:]:
        gone = gone.unionByName(state.where(F.col("fate") != "kept"))
    last = _expand(gone, with_paths)
    dropped(spark, *removed)
    return last


def _round(live: DataFrame, rnd: int, with_paths: bool) -> DataFrame:
    """The fate of every live node: raked, compressed, kept, or ended (a bare root or a bare core)."""
    extra = ["seg"] if with_paths else []
    own = live.select("id", "parent", "w", *extra, F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("child"), F.lit(True).alias("own"))
    calls = live.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("id"))).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"), F.min(live.id).alias("child"))
    joined = own.select("id", "parent", "w", *extra).join(calls, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = lambda c: F.xxhash64(F.lit(rnd), c)
    loop = F.col("parent") == F.col("id")
    has_parent = F.col("parent").isNotNull() & ~F.coalesce(loop, F.lit(False))
    unary = has_parent & (F.col("n") == 1) & (rank(F.col("id")) < rank(F.col("child"))) & (rank(F.col("id")) < rank(F.col("parent")))
    fate = F.when(has_parent & (F.col("n") == 0), "raked").when(unary, "compressed").when(~has_parent & (F.col("n") == 0), "ended").otherwise("kept")
    return joined.select("id", "parent", "w", *extra, F.when(F.col("n") == 1, F.col("child")).alias("child"), fate.alias("fate"))


def _next(state: DataFrame, with_paths: bool) -> DataFrame:
    kept = state.where(F.col("fate") == "kept")
    told = state.where(F.col("fate") == "compressed").select(F.col("child").alias("id"), F.col("parent").alias("up"), F.col("w").alias("more"), *([F.col("seg").alias("head")] if with_paths else []))
    out = kept.join(told, "id", "left")
    seg = [F.when(F.col("up").isNotNull(), F.concat("head", "seg")).otherwise(F.col("seg")).alias("seg")] if with_paths else []
    return out.select("id", F.coalesce("up", "parent").alias("parent"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), *seg)


def _expand(gone: DataFrame, with_paths: bool) -> DataFrame:
    """Pointer doubling along the recorded links."""
    spark = gone.sparkSession
    end = F.col("fate") == "ended"
    loop = end & F.col("parent").isNotNull()
    state = gone.select(
        "id", F.when(~end, F.col("parent")).alias("ptr"), F.when(end, F.lit(0)).otherwise(F.col("w")).cast("bigint").alias("w"),
        F.when(end & ~loop, F.col("id")).alias("root"), loop.alias("cyclic"), *(["seg"] if with_paths else []),
    )
    before = None
    for _ in range(MAX_ROUNDS):
        state, left = written(state, "expand", {"open": F.col("ptr").isNotNull()})
        if before is not None:
            dropped(spark, before)
        before = state
        if not left["open"]:
            break
        above = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("w").alias("w2"), F.col("root").alias("root2"), F.col("cyclic").alias("cyclic2"), *([F.col("seg").alias("seg2")] if with_paths else []))
        moved = state.where("ptr is not null").join(above, "ptr").select(
            "id", F.col("ptr2").alias("ptr"), (F.col("w") + F.col("w2")).alias("w"), F.col("root2").alias("root"), F.col("cyclic2").alias("cyclic"),
            *([F.concat("seg2", "seg").alias("seg")] if with_paths else []),
        )
        state = state.where("ptr is null").unionByName(moved)
    tree = ~F.col("cyclic")
    return state.select("id", "root", F.when(tree, F.col("w")).alias("depth"), "cyclic", *([F.when(tree, F.col("seg")).alias("path")] if with_paths else []))


def descendants(resolved: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` for each node and each of its proper ancestors, from ``path``."""
    lines = resolved.where("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return lines.where(F.col("at") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
