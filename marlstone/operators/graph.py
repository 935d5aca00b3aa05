"""Traversal, search and roll-ups over ``nodes`` and ``edges`` tables.

Nodes: ``id, project, label, name, qualified_name, file_path, properties`` (JSON text); edges: ``id, project,
source_id, target_id, type, properties``. Walks go hop by hop: a frontier joins the edges, loses what was seen, and
is written to the shared folder, so a plan never grows with the depth and nothing is collected.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import text_search
from marlstone.operators.running import running_sums
from marlstone.session import dropped, written

DEFINITIONS = ("Function", "Method", "Class", "Interface", "Struct", "Type", "Enum", "Trait")
# Boosts of labels, and what the weights of search are.
LABEL_BOOST = {"Function": 10, "Method": 10, "Route": 8, "Class": 5, "Interface": 5}
LANGUAGES = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cs": "csharp", "rb": "ruby", "sh": "shell", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "css": "css"}


def degrees(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """``(id, out_degree, in_degree, degree)`` of every node with an edge (of ``types``, if given)."""
    used = edges.where(F.col("type").isin(types)) if types else edges
    ends = used.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(used.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def steps(edges: DataFrame, direction: str, types: list[str] | None = None) -> DataFrame:
    """``(from_id, to_id, type)`` of walks ``out``, ``in`` or ``both``."""
    used = edges.where(F.col("type").isin(types)) if types else edges
    out = used.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), "type")
    back = used.select(F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"), "type")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbours(nodes: DataFrame, edges: DataFrame, start: Column, direction: str = "both", types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``(id, direction, type, neighbour_id, neighbour)`` of the nodes for which ``start`` holds, up to ``limit`` per node and direction by type and name."""
    chosen = nodes.where(start).select("id")
    parts = [chosen.join(steps(edges, d, types), F.col("id") == F.col("from_id")).withColumn("direction", F.lit(d)) for d in (("out", "in") if direction == "both" else (direction,))]
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    named = found.join(nodes.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("neighbour")), "to_id").select("id", "direction", "type", F.col("to_id").alias("neighbour_id"), "neighbour")
    if limit is None:
        return named
    order = Window.partitionBy("id", "direction").orderBy("type", "neighbour", "neighbour_id")
    return named.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def walk(start: DataFrame, hops: DataFrame, depth: int, blocked: DataFrame | None = None) -> DataFrame:
    """``(id, hop, parent_id, type)``: breadth-first from the ids of ``start``, each node once, by its least hop.

    Of several ways of least hop the one of the least ``(type, parent_id)`` counts. Nodes of ``blocked(id)`` are
    reached but not walked through, unless they are among the starts.
    """
    seen = written(start.select("id").distinct().select("id", F.lit(0).alias("hop"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(None).cast("string").alias("type")), "walk")
    layers, frontier = [seen], seen
    for hop in range(1, depth + 1):
        sources = frontier.select("id")
        if blocked is not None and hop > 1:
            sources = sources.join(blocked.select("id"), "id", "left_anti")
        reached = sources.join(hops, F.col("id") == F.col("from_id")).groupBy("to_id").agg(F.min(F.struct("type", F.col("id").alias("parent_id"))).alias("way"))
        fresh = reached.select(F.col("to_id").alias("id"), F.lit(hop).alias("hop"), F.col("way.parent_id").alias("parent_id"), F.col("way.type").alias("type"))
        before = functools.reduce(lambda a, b: a.unionByName(b), [x.select("id") for x in layers])
        fresh = fresh.join(before, "id", "left_anti")
        frontier, count = written(fresh, "walk", {"rows": F.col("id").isNotNull()})
        if not count["rows"]:
            break
        layers.append(frontier)
    return functools.reduce(lambda a, b: a.unionByName(b), layers)


def trace(nodes: DataFrame, edges: DataFrame, start: Column, direction: str = "out", depth: int = 3, types: list[str] | None = None) -> DataFrame:
    """``(id, hop, parent_id, type, qualified_name, label)`` of what is reached from the nodes for which ``start`` holds.

    Inward and both ways, without ``types``, only calls, usages and configurations are followed. Depth is at most 12.
    """
    if types is None and direction in ("in", "both"):
        types = ["CALLS", "USAGE", "CONFIGURES"]
    found = walk(nodes.where(start), steps(edges, direction, types), min(depth, 12))
    return found.join(nodes.select("id", "qualified_name", "label"), "id")


def impact(nodes: DataFrame, edges: DataFrame, start: Column, depth: int = 3, types: list[str] | None = None) -> DataFrame:
    """``(module, affected, nearest)``: what reaches the chosen nodes, counted by directory."""
    reached = walk(nodes.where(start), steps(edges, "in", types or ["CALLS", "USAGE", "CONFIGURES"]), depth).where("hop > 0").join(nodes.select("id", "file_path"), "id")
    module = F.regexp_replace("file_path", r"/?[^/]*$", "")
    return reached.groupBy(F.when(module == "", ".").otherwise(module).alias("module")).agg(F.count("*").alias("affected"), F.min("hop").alias("nearest"))


def hub_threshold(edges: DataFrame) -> int:
    """The greater of 50 and the degree at place floor(0.99 n) of the ascending degrees, from a histogram of degrees."""
    histogram = degrees(edges).groupBy("degree").count()
    total = histogram.agg(F.sum("count")).first()[0] or 0
    if not total:
        return 50
    upto = histogram.withColumn("upto", F.sum("count").over(Window.orderBy("degree")))  # a row per different degree
    return max(50, upto.where(F.col("upto") > int(0.99 * total)).agg(F.min("degree")).first()[0])


def expand(nodes: DataFrame, edges: DataFrame, start: Column, depth: int = 2) -> DataFrame:
    """``(id, hop, degree, qualified_name)``: both ways over all edges, not through hubs, in the order seeds, hop, degree, name."""
    all_degrees = degrees(edges)
    hubs = all_degrees.where(F.col("degree") > hub_threshold(edges)).select("id")
    found = walk(nodes.where(start), steps(edges, "both"), depth, hubs)
    return found.join(all_degrees.select("id", "degree"), "id", "left").join(nodes.select("id", "qualified_name"), "id").select("id", "hop", F.coalesce("degree", F.lit(0)).alias("degree"), "qualified_name").orderBy("hop", F.desc("degree"), "qualified_name")


def rendered(nodes: DataFrame, found: DataFrame, budget: int = 2_000, characters: int = 3) -> DataFrame:
    """``(place, line, shown)`` of an expansion as text: a line per node in the order seeds, hop, degree, name.

    ``shown`` are the lines that fit into ``budget`` tokens of ``characters`` each, and those of the seeds in any case.
    The lengths are summed in slices, so an expansion of any size is no burden.
    """
    kept = [c for c in ("label", "name", "file_path", "start_line", "end_line") if c in nodes.columns]
    rows = found.select("id", "hop", "degree", "qualified_name").join(nodes.select("id", *kept), "id")
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in kept else F.lit("")
    name = F.coalesce(F.nullif(field("name"), F.lit("")), F.coalesce("qualified_name", F.lit("")))
    named = F.when((F.trim("qualified_name") != "") & ~field("label").isin("File", "Folder"), F.concat(F.lit("qn="), F.trim("qualified_name"), F.lit(" "))).otherwise("")
    start, end = (F.coalesce(field(c).try_cast("int"), F.lit(0)) for c in ("start_line", "end_line"))
    where = F.when(start <= 0, "-").when(end > start, F.concat(F.lit("L"), start, F.lit("-"), end)).otherwise(F.concat(F.lit("L"), start))
    package = F.regexp_replace(F.coalesce("qualified_name", F.lit("")), r"(?<=.)\.[^.]*$", "")
    line = F.concat(F.lit("NODE "), name, F.lit(" ["), named, F.lit("src="), field("file_path"), F.lit(" loc="), where, F.lit(" community="), package, F.lit("]"))
    lines = rows.select(F.lit(0).alias("_all"), "hop", (-F.col("degree")).alias("_rare"), F.coalesce("qualified_name", F.lit("")).alias("_name"), "id", line.alias("line"))
    placed = running_sums(lines, ["_all"], ["hop", "_rare", "_name", "id"], {"place": F.lit(1), "upto": F.octet_length("line") + 1})
    return placed.select("place", "line", ((F.col("upto") <= budget * characters) | (F.col("hop") == 0)).alias("shown"))


def search(nodes: DataFrame, edges: DataFrame, query: str = "", semantic: DataFrame | None = None, limit: int = 50, **filters) -> DataFrame:
    """``(id, qualified_name, way, score)``: the best ``limit`` (at most 500) nodes by the words of a query, or without words by the
    filters of :func:`structural_search`, and the best of ``semantic(id, score)``, alone if nothing else is asked for."""
    limit = min(limit if limit > 0 else 50, 500)
    best = lambda df, way: df.orderBy(F.desc("score"), "qualified_name", "id").limit(limit).select("id", "qualified_name", F.lit(way).alias("way"), F.col("score").cast("double").alias("score"))
    near = None if semantic is None else best(semantic.select("id", "score").join(nodes.select("id", "qualified_name"), "id"), "semantic")
    if near is not None and not query and not filters:
        return near
    if text_search.query_words(query):
        wanted = structural_search(nodes, edges, **filters).select("id")
        rows = nodes.join(wanted, "id", "left_semi").select("id", "qualified_name", text_search.split_names(F.col("name")).alias("words"), *(["file_path"] if "file_path" in nodes.columns else []))
        fields = {"words": 2.0, "qualified_name": 1.0} | ({"file_path": 1.0} if "file_path" in nodes.columns else {})
        told = best(text_search.bm25(rows, fields, query).withColumnRenamed("bm25", "score"), "words")
    else:
        told = best(structural_search(nodes, edges, **filters), "structure")
    return told if near is None else told.unionByName(near)


def _tarjan(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The least id of its strong component for each node on a cycle of a small graph without self-loops."""
    out: dict[int, list[int]] = {}
    for s, t in pairs:
        out.setdefault(s, []).append(t)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    open_, path, result = set(), [], {}
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out.get(root, ())))]
        index[root] = low[root] = len(index)
        path.append(root)
        open_.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    path.append(nxt)
                    open_.add(nxt)
                    work.append((nxt, iter(out.get(nxt, ()))))
                    break
                if nxt in open_:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(path.pop())
                        open_.discard(members[-1])
                    if len(members) > 1:
                        result.update(dict.fromkeys(members, min(members)))
    return result


def _solved(frames) -> pd.DataFrame:
    """``(id, component)`` of the edges ``(s, t)`` of all ``frames``, by one task."""
    pairs = [pair for f in frames for pair in zip(f["s"].tolist(), f["t"].tolist(), strict=True)]
    return pd.DataFrame(list(_tarjan(pairs).items()), columns=["id", "component"], dtype="int64")


def _reach_labels(live: DataFrame) -> DataFrame:
    """``(id, f, b, moved)`` of the nodes of ``live(s, t)``: the least id that reaches a node and the least that it reaches.

    A node whose labels changed offers them along its edges. A label is also exchanged for that label's own, which mostly
    takes it over many nodes a round; at worst, where it enters a long way from aside, it takes a round for each.
    """
    none, moved = F.lit(None).cast("bigint"), (F.col("f") < F.col("f0")) | (F.col("b") < F.col("b0"))
    labels = written(live.select(F.explode(F.array("s", "t")).alias("id")).distinct().select("id", F.col("id").alias("f"), F.col("id").alias("b"), F.lit(True).alias("moved")), "labels")
    while True:
        fresh = labels.where("moved").drop("moved")
        own = labels.select("id", "f", "b", F.col("f").alias("f0"), F.col("b").alias("b0"))
        ahead = live.join(fresh, F.col("s") == F.col("id")).select(F.col("t").alias("id"), "f", none.alias("b"), none.alias("f0"), none.alias("b0"))
        behind = live.join(fresh, F.col("t") == F.col("id")).select(F.col("s").alias("id"), none.alias("f"), "b", none.alias("f0"), none.alias("b0"))
        best = own.unionByName(ahead).unionByName(behind).groupBy("id").agg(*[F.min(c).alias(c) for c in ("f", "b", "f0", "b0")])
        further = best.join(labels.select(F.col("id").alias("f"), F.col("f").alias("f2")), "f").join(labels.select(F.col("id").alias("b"), F.col("b").alias("b2")), "b")
        after = further.select("id", F.least("f", "f2").alias("f"), F.least("b", "b2").alias("b"), "f0", "b0").select("id", "f", "b", moved.alias("moved"))
        after, count = written(after, "labels", {"moved": F.col("moved")})
        dropped(live.sparkSession, labels)
        labels = after
        if not count["moved"]:
            return labels


def _peeled(live: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """What is left of ``live(s, t)`` without the nodes from which a single way leads to a dead end or into a closed loop,
    ``(id, component)`` of the nodes on these loops, and how many edges are left.

    The single ways are followed by pointer jumping, four lengths a round. Nodes that meet no end are on a loop or on the way into
    one. When neither ends nor least ids change, the nodes where ways lead are looked at: if no two of them have the same next
    node, they are the loops, and the ways are longer than each of them, so the least id on its way is a node's component.
    """
    spark = live.sparkSession
    ways = live.select(F.col("s").alias("id"), F.col("t").alias("to")).unionByName(live.select(F.col("t").alias("id"), F.lit(None).cast("bigint").alias("to")))
    few = ways.groupBy("id").agg(F.count("to").alias("n"), F.max("to").alias("to")).where("n < 2")
    state, count = written(few.select("id", "to", F.col("to").alias("ptr"), F.col("id").alias("least"), F.when(F.col("n") == 0, "dead").alias("end"), F.lit(True).alias("moved")), "peel", {"open": F.col("end").isNull()})
    while count["open"]:
        far = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("least").alias("least2"), F.col("end").alias("end2"), F.lit(True).alias("few"))
        walked = state.where("end is null").withColumn("least0", F.col("least"))
        for _ in range(3):
            step = walked.join(far, "ptr", "left")
            met = F.col("end").isNotNull()
            walked = step.select("id", "to", F.when(met, F.col("ptr")).otherwise(F.coalesce("ptr2", "ptr")).alias("ptr"), F.least("least", "least2").alias("least"), "least0", F.when(met, F.col("end")).when(F.col("few").isNull(), "open").otherwise(F.col("end2")).alias("end"))
        moved = walked.select("id", "to", "ptr", "least", "end", (F.col("end").isNotNull() | (F.col("least") < F.col("least0"))).alias("moved"))
        after, count = written(state.where("end is not null").withColumn("moved", F.lit(False)).unionByName(moved), "peel", {"open": F.col("end").isNull(), "moved": F.col("moved")})
        dropped(spark, state)
        state = after
        if count["open"] and not count["moved"]:
            met = state.where("end is null").select(F.col("ptr").alias("id")).distinct()
            on = state.where("end is null").join(met, "id").agg(F.count("*").alias("n"), F.count_distinct("to").alias("next")).first()
            if on["n"] == on["next"]:
                break
    loops = state.where("end is null")
    found = written(loops.join(loops.select(F.col("ptr").alias("id")), "id", "left_semi").select("id", F.col("least").alias("component")), "sccdone")
    gone = state.where("end is null or end = 'dead'").select("id")
    rest, count = written(live.join(gone, F.col("s") == F.col("id"), "left_anti").join(gone, F.col("t") == F.col("id"), "left_anti"), "scc", {"rows": F.col("s").isNotNull()})
    dropped(spark, state)
    return rest, found, count["rows"]


def components(edges: DataFrame, small: int = 200_000) -> DataFrame:
    """``(id, component)`` of the nodes on directed cycles: strongly connected, ``component`` is its least id.

    At most ``small`` edges are solved by one task. Of more, single ways out and in are peeled off, and as soon as that
    takes less than a tenth, the rest is split: nodes which are reached by the same least id as they reach are its component,
    and between nodes that differ in either id no edge lies on a cycle. That leaves parts without a way from one to
    another; those of at most ``small`` edges are solved, many tasks at once, larger ones peeled and split again.
    """
    spark = edges.sparkSession
    kind = "id bigint, component bigint"
    pairs = written(edges.select(F.col("source_id").cast("bigint").alias("s"), F.col("target_id").cast("bigint").alias("t")).distinct(), "scc")
    live, count = written(pairs.where("s <> t"), "scc", {"rows": F.col("s").isNotNull()})
    found = [written(pairs.where("s = t").select(F.col("s").alias("id"), F.col("s").alias("component")), "sccdone")]
    while count["rows"] > small:
        before = count["rows"]
        for _ in range(2):  # the ways out; if they are few, the ways in
            rest, loops, count["rows"] = _peeled(live)
            found.append(loops)
            dropped(spark, live)
            live = rest
            if count["rows"] < 0.9 * before:
                break
            live = rest.select(F.col("t").alias("s"), F.col("s").alias("t"))
            live._marlstone_path = rest._marlstone_path  # noqa: SLF001
        if count["rows"] <= small or count["rows"] < 0.9 * before:
            continue
        labels = _reach_labels(live)
        others = labels.where("f = b and id <> f").select("id", F.col("f").alias("component"))
        found.append(written(others.unionByName(others.select(F.col("component").alias("id"), "component").distinct()), "sccdone"))
        open_ = labels.where("f <> b").select("id", "f", "b")
        parts = live.join(open_.toDF("s", "f", "b"), "s").join(open_.toDF("t", "f2", "b2"), "t").where("f = f2 and b = b2").select("s", "t", "f", "b")
        parts, count = written(parts, "sccparts", {"rows": F.col("s").isNotNull()})
        dropped(spark, live, labels)
        live = parts
        if count["rows"] > small > 0:
            sizes = parts.groupBy("f", "b").agg(F.count("*").alias("n"))
            buckets = -(-2 * count["rows"] // small)
            little = parts.join(sizes.where(F.col("n") <= small), ["f", "b"]).withColumn("bucket", F.pmod(F.xxhash64("f", "b"), F.lit(buckets)))
            found.append(written(little.groupBy("bucket").applyInPandas(lambda rows: _solved([rows]), kind), "sccdone"))
            live, count = written(parts.join(sizes.where(F.col("n") > small), ["f", "b"], "left_semi"), "scc", {"rows": F.col("s").isNotNull()})
            dropped(spark, parts)
    if count["rows"]:
        found.append(written(live.select("s", "t").coalesce(1).mapInPandas(lambda frames: iter([_solved(frames)]), kind), "sccdone"))
    dropped(spark, pairs, live)
    return spark.read.schema(kind).parquet(*[x._marlstone_path for x in found]).groupBy("id").agg(F.min("component").alias("component"))  # noqa: SLF001


# Roll-ups


def schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, name, n)``: counts of node labels, edge types, and (label, type, label) patterns."""
    ends = edges.join(nodes.select(F.col("id").alias("source_id"), F.col("label").alias("a")), "source_id").join(nodes.select(F.col("id").alias("target_id"), F.col("label").alias("b")), "target_id")
    patterns = ends.groupBy(F.concat(F.lit("("), "a", F.lit(")-["), "type", F.lit("]->("), "b", F.lit(")")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("pattern").alias("kind"), "name", "n")
    labels = nodes.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    types = edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n")
    return labels.unionByName(types).unionByName(patterns)


def property_names(nodes: DataFrame) -> DataFrame:
    """``(label, property, n)``: which dynamic properties the nodes of each label have."""
    return nodes.select("label", F.explode(F.json_object_keys("properties")).alias("property")).groupBy("label", "property").agg(F.count("*").alias("n"))


def package(qualified: str = "qualified_name") -> Column:
    """The third part of a name of four or more, else the second, else the first."""
    parts = F.split(qualified, r"\.")
    return F.when(F.size(parts) >= 4, parts[2]).when(F.size(parts) >= 2, parts[1]).otherwise(parts[0])


def packages(nodes: DataFrame, top: int = 15) -> DataFrame:
    """The packages of most nodes (a top list)."""
    return nodes.where(F.col("label").isin(*DEFINITIONS)).groupBy(package().alias("package")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "package").limit(top)


def languages(nodes: DataFrame, top: int = 10) -> DataFrame:
    """The languages of most files, by extension (a top list)."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    files = nodes.where(F.col("file_path") != "").select("file_path").distinct()
    return files.select(known[F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1))].alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language").limit(top)


def boundaries(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """``(source, target, calls)``: the most frequent calls between different packages (a top list)."""
    home = nodes.select("id", package().alias("p"))
    crossed = edges.where("type = 'CALLS'").join(home.toDF("source_id", "source"), "source_id").join(home.toDF("target_id", "target"), "target_id").where("source <> target")
    return crossed.groupBy("source", "target").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "source", "target").limit(top)


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(package, fan_in, fan_out, layer)`` of the packages of the top boundaries or with entry points or routes."""
    crossed = boundaries(nodes, edges)
    sides = crossed.select(F.col("source").alias("package"), F.lit(0).alias("i"), F.col("calls").alias("o")).unionByName(crossed.select(F.col("target").alias("package"), F.col("calls").alias("i"), F.lit(0).alias("o")))
    marks = nodes.select(package().alias("package"), F.lit(0).alias("i"), F.lit(0).alias("o"), (F.col("label") == "Route").alias("route"), F.coalesce(F.get_json_object("properties", "$.is_entry_point").isin("true", "1"), F.lit(False)).alias("entry")).where("route or entry")
    fans = sides.withColumns({"route": F.lit(False), "entry": F.lit(False)}).unionByName(marks).groupBy("package").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.bool_or("route").alias("route"), F.bool_or("entry").alias("entry"))
    i, o = F.col("fan_in"), F.col("fan_out")
    layer = F.when(F.col("entry") & (o > 0) & (i == 0), "entry").when(F.col("route"), "api").when((i > o) & (i > 3), "core").when((o == 0) & (i > 0), "leaf").when((i == 0) & (o > 0), "entry").otherwise("internal")
    return fans.select("package", "fan_in", "fan_out", layer.alias("layer"))


def file_tree(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """``(path, kind, children)`` of files and directories down to ``depth``."""
    files = nodes.where(F.col("file_path") != "").select("file_path").distinct()
    parts = F.split("file_path", "/")
    rows = files.select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))).alias("d"))
    named = rows.select(F.array_join(F.slice("p", 1, F.col("d")), "/").alias("path"), (F.size("p") > F.col("d")).alias("dir"), F.when(F.size("p") > F.col("d"), F.element_at("p", F.col("d") + 1)).alias("child"))
    return named.groupBy("path").agg(F.when(F.bool_or("dir"), "dir").otherwise("file").alias("kind"), F.count_distinct("child").alias("children"))


def hotspots(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The most called functions and methods that are no tests (a top list)."""
    wanted = nodes.where(F.col("label").isin("Function", "Method") & ~F.lower("file_path").contains("test"))
    counts = edges.where("type = 'CALLS'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    return wanted.join(counts, "id").orderBy(F.desc("fan_in"), "qualified_name").limit(top).select("qualified_name", "fan_in")


def structural_search(nodes: DataFrame, edges: DataFrame, name: str | None = None, labels: list[str] | None = None, path: str | None = None, relation: str | None = None, uncalled: bool = False, degree: tuple[int, int] | None = None) -> DataFrame:
    """``(id, qualified_name, label, score)`` of nodes by a regular expression on the name, labels, a path prefix, having
    an edge of a type, not being called, and bounds of the degree; scored by label, then degree."""
    found = nodes
    if name is not None:
        found = found.where(F.col("name").rlike(f"(?i){name}"))
    if labels:
        found = found.where(F.lower("label").isin([x.lower() for x in labels]))
    if path is not None:
        found = found.where(F.col("file_path").startswith(path))
    if relation is not None:
        found = found.join(edges.where(F.col("type") == relation).select(F.col("source_id").alias("id")), "id", "left_semi")
    if uncalled:
        found = found.join(edges.where("type = 'CALLS'").select(F.col("target_id").alias("id")), "id", "left_anti")
    found = found.join(degrees(edges).select("id", "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if degree is not None:
        found = found.where(F.col("degree").between(*degree))
    boost = F.coalesce(F.create_map(*[F.lit(x) for pair in LABEL_BOOST.items() for x in pair])[F.col("label")], F.lit(0))
    return found.select("id", "qualified_name", "label", (boost * 1000 + F.col("degree")).alias("score"))


def lookup(nodes: DataFrame, identity: str) -> DataFrame:
    """The nodes of a qualified name; if there are none, of a name ending in ``.identity``; if none, of that name."""
    stage = F.when(F.col("qualified_name") == identity, 1).when(F.endswith(F.col("qualified_name"), F.lit(f".{identity}")), 2).when(F.col("name") == identity, 3)
    hits = nodes.withColumn("stage", stage).where("stage is not null")
    return hits.withColumn("_best", F.min("stage").over(Window.partitionBy())).where("stage = _best").drop("_best")


def coverage(files: DataFrame, nodes: DataFrame, gaps: DataFrame) -> DataFrame:
    """``(project, rel_path, status, kinds)``: ``complete``, ``partial`` (with the kinds of gaps), or ``not_indexed``."""
    seen = nodes.where(F.col("file_path") != "").select("project", F.col("file_path").alias("rel_path")).distinct().withColumn("_seen", F.lit(True))
    holes = gaps.groupBy("project", "rel_path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    joined = files.select("project", "rel_path").distinct().join(seen, ["project", "rel_path"], "left").join(holes, ["project", "rel_path"], "left")
    return joined.select("project", "rel_path", F.when(F.col("kinds").isNotNull(), "partial").when(F.col("_seen"), "complete").otherwise("not_indexed").alias("status"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def missed_graph(gaps: DataFrame) -> DataFrame:
    """``(project, path, label)``: folders and files of ``gaps`` of parsed sources, under ``<project>::missed``."""
    paths = gaps.where(~F.startswith(F.col("kind"), F.lit("not_indexed"))).select("project", "rel_path").distinct()
    parts = F.split("rel_path", "/")
    rows = paths.select("project", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("d"))
    return rows.select(F.concat("project", F.lit("::missed")).alias("project"), F.array_join(F.slice("p", 1, F.col("d")), "/").alias("path"), F.when(F.col("d") == F.size("p"), "File").otherwise("Folder").alias("label")).distinct()


# Derivations


def change_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(project, rel_path, change, old_path)`` between two file listings ``(project, rel_path, sha256)``.

    ``added``, ``deleted``, ``modified`` or ``renamed``: an added file is a rename if its digest is that of exactly
    one added and exactly one deleted file of the project.
    """
    keys = ["project", "rel_path"]
    both = before.select(*keys, F.col("sha256").alias("old")).join(after.select(*keys, F.col("sha256").alias("new")), keys, "full")
    diff = both.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")).withColumn("digest", F.coalesce("new", "old"))
    moved = diff.where("change <> 'modified'").groupBy("project", "digest").agg(
        F.count_if(F.col("change") == "added").alias("a"), F.count_if(F.col("change") == "deleted").alias("d"),
        F.max(F.when(F.col("change") == "added", F.col("rel_path"))).alias("rel_path"), F.max(F.when(F.col("change") == "deleted", F.col("rel_path"))).alias("old_path"),
    ).where("a = 1 and d = 1").select("project", "rel_path", F.lit("renamed").alias("change"), "old_path")
    used = moved.select("project", "rel_path").unionByName(moved.select("project", F.col("old_path").alias("rel_path")))
    rest = diff.join(used, keys, "left_anti").select(*keys, "change", F.lit(None).cast("string").alias("old_path"))
    return rest.unionByName(moved)


def co_change(commits: DataFrame, most_files: int = 20, least: int = 3, score: float = 0.3) -> DataFrame:
    """``(file_a, file_b, together, score, last)`` from ``(commit, file[, at])``: pairs of files changed together in ``least`` or
    more commits, and in ``score`` or more of the commits of the rarer one, and when they last were.

    Commits of more than ``most_files`` files count for nothing: such a commit says little of what belongs together.
    """
    rows = commits if "at" in commits.columns else commits.withColumn("at", F.lit(None).cast("timestamp"))
    rows = rows.groupBy("commit", "file").agg(F.max("at").alias("at"))
    small = rows.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= most_files).select("commit")
    kept = rows.join(small, "commit", "left_semi")
    totals = kept.groupBy("file").agg(F.count("*").alias("total"))
    both = kept.select("commit", F.col("file").alias("file_a"), "at").join(kept.select("commit", F.col("file").alias("file_b")), "commit").where("file_a < file_b")
    pairs = both.groupBy("file_a", "file_b").agg(F.count("*").alias("together"), F.max("at").alias("last")).where(F.col("together") >= least)
    scored = pairs.join(totals.toDF("file_a", "ta"), "file_a").join(totals.toDF("file_b", "tb"), "file_b").select("file_a", "file_b", "together", (F.col("together") / F.least("ta", "tb")).alias("score"), "last")
    return scored.where(F.col("score") >= score)


def file_history(commits: DataFrame) -> DataFrame:
    """``(file, changes, last)`` from ``(commit, file, at)``: in how many commits a file was changed and when last."""
    return commits.groupBy("file").agg(F.count_distinct("commit").alias("changes"), F.max("at").alias("last"))


def tests_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(source_id, target_id)``: calls from code in test files to code outside them."""
    is_test = F.lower("file_path").rlike(r"(^|/)tests?/|_test\.|\.test\.|\.spec\.|(^|/)test_")
    side = nodes.where(F.col("label").isin("Function", "Method")).select("id", is_test.alias("test"))
    return edges.where("type = 'CALLS'").join(side.toDF("source_id", "a"), "source_id").join(side.toDF("target_id", "b"), "target_id").where("a and not b").select("source_id", "target_id")


def implements(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """``(type, interface)`` where the methods of a type hold all of an interface's; both are ``(owner, method)``.

    Counted on an equi-join of method names, pre-aggregated per pair; an interface without methods is implemented by none.
    """
    need = interfaces.distinct().groupBy(F.col("owner").alias("interface")).agg(F.count("*").alias("need"))
    shared = methods.distinct().toDF("type", "method").join(interfaces.distinct().toDF("interface", "method"), "method").groupBy("type", "interface").agg(F.count("*").alias("have"))
    return shared.join(need, "interface").where("have = need").select("type", "interface")


def community_report(nodes: DataFrame, edges: DataFrame, top: int = 12, most: int = 8_000) -> DataFrame:
    """``(community, members, cohesion, name)`` of the communities of two or more definitions by calls (a top list).

    Cohesion is the share of a community's edges that stay inside; its name is its commonest package.
    """
    from marlstone.operators.vectors import communities

    wanted = nodes.where(F.col("label").isin(*DEFINITIONS)).select("id", package().alias("package"))
    calls = edges.where("type = 'CALLS'").join(wanted.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(wanted.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    home = written(communities(calls.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(1.0).alias("w")), most), "communities")
    ends = calls.where("source_id <> target_id").join(home.toDF("source_id", "x"), "source_id").join(home.toDF("target_id", "y"), "target_id")
    inside = ends.where("x = y").groupBy(F.col("x").alias("community")).agg(F.count("*").alias("inside"))
    across = ends.where("x <> y").select(F.explode(F.array("x", "y")).alias("community")).groupBy("community").agg(F.count("*").alias("across"))
    named = home.join(wanted, "id").groupBy("community", "package").agg(F.count("*").alias("n")).groupBy("community").agg(F.sum("n").alias("members"), F.min(F.struct((-F.col("n")).alias("n"), "package"))["package"].alias("name")).where("members >= 2")
    both = named.join(inside, "community", "left").join(across, "community", "left")
    share = F.coalesce(F.try_divide(F.coalesce("inside", F.lit(0)), F.coalesce("inside", F.lit(0)) + F.coalesce("across", F.lit(0))), F.lit(0.0))
    return both.select("community", "members", share.alias("cohesion"), "name").orderBy(F.desc("members"), "community").limit(top)
