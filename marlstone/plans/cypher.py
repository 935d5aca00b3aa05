"""Compiling Cypher to DataFrame plans.

A variable is a group of flat columns (``v__id``, ``v__name``, ...), so that Catalyst prunes what a query does not
read and pushes filters to the scans; a hop is an equi-join of edges and nodes. Values follow the language, not
SQL: comparisons are never null, texts that look like numbers compare as numbers, an empty text is null to
``IS NULL`` and ``coalesce``, null prints as ``<nil>``. Where the plan can know that plain SQL means the same (a
literal that is no number, two numbers), it uses plain SQL, which pushes down.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.cypher_syntax import AGGREGATES, CypherError, NodePattern, Projection, RelPattern, Single, is_aggregate, parse

NODE = {"id": "number", "label": "text", "name": "text", "qualified_name": "text", "file_path": "text", "start_line": "number", "end_line": "number", "properties": "text"}
EDGE = {"id": "number", "source_id": "number", "target_id": "number", "type": "text", "properties": "text"}
MAX_ROWS = 100_000


class Value:
    """A column and what is known of it: text, number, bool, list, or any (text of a dynamic property)."""

    def __init__(self, column: Column, kind: str, literal: object = ...):
        self.column, self.kind, self.literal = column, kind, literal


def printed(v: Value) -> Column:
    text = v.column.cast("string")
    if v.kind == "number":
        text = F.regexp_replace(text, r"\.0$", "")
    return F.coalesce(text, F.lit("<nil>"))


def number(v: Value) -> Column:
    if v.kind == "number":
        return v.column.cast("double")
    return v.column.try_cast("double") if v.kind in ("text", "any") else F.lit(None).cast("double")


def _looks_number(x: object) -> bool:
    try:
        float(x)
        return True
    except (TypeError, ValueError):
        return False


def equal(a: Value, b: Value) -> Column:
    for x, y in ((a, b), (b, a)):
        if x.literal is None:
            return y.column.isNull()
        if isinstance(x.literal, str) and not _looks_number(x.literal) and y.kind in ("text", "any"):
            return F.coalesce(y.column == x.literal, F.lit(False))
    if a.kind == b.kind and a.kind in ("number", "bool"):
        return a.column.eqNullSafe(b.column)
    na, nb = number(a), number(b)
    same = F.when(na.isNotNull() & nb.isNotNull(), na == nb).otherwise(printed(a) == printed(b))
    return F.when(a.column.isNull() & b.column.isNull(), True).when(a.column.isNull() | b.column.isNull(), False).otherwise(same)


def compared(op: str, a: Value, b: Value) -> Column:
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    na, nb = number(a), number(b)
    return F.when(na.isNotNull() & nb.isNotNull(), test(na, nb)).otherwise(test(printed(a), printed(b)))


def truthy(v: Value) -> Column:
    zero = {"bool": v.column, "text": v.column != "", "any": v.column != "", "number": v.column != 0}.get(v.kind, v.column.isNotNull())
    return F.coalesce(zero, F.lit(False))


class Graph:
    """Nodes and edges as tables; columns that are missing count as null."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        fill = lambda df, names: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("int" if k == "number" else "string").alias(c) for c, k in names.items()])
        self.nodes, self.edges = fill(nodes, NODE), fill(edges, EDGE)
        self.spark: SparkSession = nodes.sparkSession


class _Plan:
    def __init__(self, graph: Graph, params: dict):
        self.graph, self.params = graph, params
        self.frame: DataFrame | None = None
        self.vars: dict[str, str] = {}  # node, edge, or the kind of a scalar
        self.hidden = 0

    def fresh(self) -> str:
        self.hidden += 1
        return f"_{self.hidden}"

    # Matching

    def node_table(self, var: str, p: NodePattern) -> DataFrame:
        table = self.graph.nodes.select(*[F.col(c).alias(f"{var}__{c}") for c in NODE])
        return self.constrain(table, var, p.labels, "label", p.props)

    def constrain(self, table: DataFrame, var: str, names: list[str], column: str, props: dict, params: bool = True) -> DataFrame:
        if names:
            table = table.where(F.lower(f"{var}__{column}").isin([n.lower() for n in names]))
        for key, e in props.items():
            if not params and e[0] == "param":
                return table.where(F.lit(False))  # a parameter never matches in a relationship
            inner = _Plan(self.graph, self.params)
            inner.vars = {**self.vars, var: "node" if column == "label" else "edge"}
            table = table.where(equal(inner.prop(var, key), inner.value(e)))
        return table

    def edge_table(self, var: str, p: RelPattern) -> DataFrame:
        edges = self.graph.edges.select(*[F.col(c).alias(f"{var}__{c}") for c in EDGE])
        edges = self.constrain(edges, var, p.types, "type", p.props, params=False)
        out = edges.withColumns({f"{var}__from": F.col(f"{var}__source_id"), f"{var}__to": F.col(f"{var}__target_id")})
        back = edges.withColumns({f"{var}__from": F.col(f"{var}__target_id"), f"{var}__to": F.col(f"{var}__source_id")})
        return {"out": out, "in": back, "any": out.unionByName(back.where(F.col(f"{var}__source_id") != F.col(f"{var}__target_id")))}[p.way]

    def match(self, path: list, optional: bool) -> None:
        names = [p.var or self.fresh() for p in path[::2]]
        bound = [n for n in names if n in self.vars]
        if optional or (self.frame is not None and names[0] not in self.vars):
            other = _Plan(self.graph, self.params)
            other.hidden = self.hidden + 1000 * (len(self.vars) + 1)
            other.match([NodePattern(n, p.labels, p.props) if i % 2 == 0 else p for i, p in enumerate(path) for n in [names[i // 2]]], False)
            right = other.frame
            shared = [n for n in dict.fromkeys(bound)]
            keep = [c for c in right.columns if c.split("__")[0] not in shared]
            right = right.select(*keep, *[F.col(f"{n}__id").alias(f"_join_{n}") for n in shared])
            if self.frame is None:
                self.frame = self.graph.spark.range(1).select(F.lit(1).alias("_unit"))
            on = functools.reduce(lambda a, b: a & b, [F.col(f"{n}__id") == F.col(f"_join_{n}") for n in shared], F.lit(True))
            self.frame = self.frame.join(right, on, "left" if optional else "inner").drop(*[f"_join_{n}" for n in shared])
            self.vars |= {n: k for n, k in other.vars.items() if n not in self.vars}
            return
        first = path[0]
        if names[0] in self.vars:
            self.frame = self.constrain(self.frame.where(F.col(f"{names[0]}__id").isNotNull()), names[0], first.labels, "label", first.props)
        else:
            self.frame = self.node_table(names[0], first)
            self.vars[names[0]] = "node"
        rels = path[1::2]
        trail = len(rels) > 1 or any(not r.single for r in rels)
        if trail:
            self.frame = self.frame.withColumn("_used", F.array().cast("array<bigint>"))
        for rel, node, here, there in zip(rels, path[2::2], names, names[1:], strict=False):
            self.hop(rel, node, here, there, trail)
        if trail:
            self.frame = self.frame.drop("_used")

    def hop(self, rel: RelPattern, node: NodePattern, here: str, there: str, trail: bool) -> None:
        var = rel.var or self.fresh()
        edges = self.edge_table(var, rel)
        known = there in self.vars
        start = self.frame.withColumn("_at", F.col(f"{here}__id"))
        reached = []
        if rel.least == 0 and rel.var is None:
            reached.append(start)
        step = start
        edge_columns = [c for c in edges.columns if c.startswith(f"{var}__") and not c.endswith(("__from", "__to"))]
        for k in range(1, rel.most + 1):
            joined = step.drop(*edge_columns).join(edges, F.col("_at") == F.col(f"{var}__from"))
            if trail:
                joined = joined.where(~F.array_contains("_used", F.col(f"{var}__id"))).withColumn("_used", F.array_append("_used", F.col(f"{var}__id")))
            step = joined.withColumn("_at", F.col(f"{var}__to")).drop(f"{var}__from", f"{var}__to")
            if k >= rel.least:
                reached.append(step)
        frame = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reached)
        if known:
            frame = self.constrain(frame.where(F.col("_at") == F.col(f"{there}__id")), there, node.labels, "label", node.props)
        else:
            frame = frame.join(self.node_table(there, node), F.col("_at") == F.col(f"{there}__id"))
            self.vars[there] = "node"
        if rel.var:
            self.vars[var] = "edge"
            frame = frame.drop("_at")
        else:
            frame = frame.drop("_at", *edge_columns)
        self.frame = frame

    # Expressions

    def prop(self, var: str, key: str) -> Value:
        kind = self.vars.get(var)
        if kind is None:
            return Value(F.lit(None).cast("string"), "text", None)
        if kind not in ("node", "edge"):
            return Value(F.get_json_object(F.col(var).cast("string"), f"$.{key}"), "any")
        fields = NODE if kind == "node" else EDGE
        low = key.lower()
        if low == "properties":
            return Value(F.col(f"{var}__properties"), "text")
        if low in fields:
            return Value(F.col(f"{var}__{low}"), fields[low])
        if kind == "node" and low in ("in_degree", "out_degree"):
            self.degree(var, low)
            return Value(F.col(f"{var}__{low}"), "number")
        return Value(F.get_json_object(f"{var}__properties", f"$.{key}"), "any")

    def degree(self, var: str, which: str) -> None:
        """Calls into or out of the node, joined once from a pre-aggregated table."""
        column = f"{var}__{which}"
        if self.frame is None or column in self.frame.columns:
            return
        side = "target_id" if which == "in_degree" else "source_id"
        counts = self.graph.edges.where(F.col("type") == "CALLS").groupBy(F.col(side).alias("_node")).agg(F.count("*").alias(column))
        self.frame = self.frame.join(counts, F.col(f"{var}__id") == F.col("_node"), "left").drop("_node").withColumn(column, F.coalesce(column, F.lit(0)))

    def value(self, e: tuple) -> Value:
        op = e[0]
        if op in ("lit", "param"):
            if op == "param" and e[1] not in self.params:
                raise CypherError(f"missing parameter ${e[1]}")
            x = e[1] if op == "lit" else self.params[e[1]]
            if isinstance(x, (list, tuple)):
                return self.value(("list", [("lit", y) for y in x]))
            kind = "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "text"
            return Value(F.lit(x) if x is not None else F.lit(None).cast("string"), kind, x)
        if op == "var":
            kind = self.vars.get(e[1])
            if kind is None:
                return Value(F.lit(None).cast("string"), "text", None)
            return Value(self.whole(e[1]), "struct") if kind in ("node", "edge") else Value(F.col(e[1]), kind)
        if op == "prop":
            return self.prop(e[1], e[2])
        if op == "label":
            known = self.vars.get(e[1]) == "node"
            return Value(F.coalesce(F.lower(f"{e[1]}__label").isin([x.lower() for x in e[2]]), F.lit(False)) if known else F.lit(False), "bool")
        if op == "list":
            items = [self.value(x) for x in e[1]]
            plain = {i.kind for i in items}
            kind = "number" if plain == {"number"} else "bool" if plain == {"bool"} else "text"
            cells = [i.column if len(plain) == 1 else F.when(i.column.isNotNull(), printed(i)) for i in items]
            return Value(F.array(*cells) if cells else F.array().cast("array<string>"), f"list {kind}", e[1])
        if op in ("and", "or", "xor"):
            a, b = truthy(self.value(e[1])), truthy(self.value(e[2]))
            return Value(a & b if op == "and" else a | b if op == "or" else a != b, "bool")
        if op == "not":
            return Value(~truthy(self.value(e[1])), "bool")
        if op == "is null":
            v = self.value(e[1])
            return Value(v.column.isNull() | (v.column.cast("string") == "") if v.kind in ("text", "any") else v.column.isNull(), "bool")
        if op in ("=", "<>"):
            same = equal(self.value(e[1]), self.value(e[2]))
            return Value(same if op == "=" else ~same, "bool")
        if op in ("<", "<=", ">", ">="):
            return Value(compared(op, self.value(e[1]), self.value(e[2])), "bool")
        if op in ("contains", "starts", "ends"):
            a, b = printed(self.value(e[1])), printed(self.value(e[2]))
            return Value({"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[op](a, b), "bool")
        if op == "=~":
            return Value(F.regexp_like(printed(self.value(e[1])), printed(self.value(e[2]))), "bool")
        if op in ("in", "not in"):
            return self.member(e)
        if op == "case":
            branches = [(truthy(self.value(t)), self.value(v)) for t, v in e[1]]
            other = self.value(e[2])
            kinds = {v.kind for _, v in branches if v.literal is not None} | ({other.kind} if other.literal is not None else set())
            one = len(kinds) == 1
            cell = lambda v: v.column if one else F.when(v.column.isNotNull(), printed(v))
            column = functools.reduce(lambda c, tv: F.when(*tv) if c is None else c.when(*tv), [(t, cell(v)) for t, v in branches], None)
            return Value(column.otherwise(cell(other)) if other.literal is not None else column, kinds.pop() if one else "text")
        if op == "exists":
            return Value(self.exists(e[1]), "bool")
        if op == "call":
            if e[1] in AGGREGATES:
                raise CypherError("an aggregate can only be a whole item of WITH or RETURN")
            return self.function(e[1], [self.value(a) if a[0] != "star" else Value(F.lit(1), "number") for a in e[2]], e[2])
        raise CypherError(f"cannot evaluate {op}")

    def member(self, e: tuple) -> Value:
        item, group = self.value(e[1]), self.value(e[2])
        if not group.kind.startswith("list"):
            raise CypherError("IN needs a list")
        if isinstance(group.literal, list):
            found = functools.reduce(lambda a, b: a | b, [equal(item, self.value(x)) for x in group.literal], F.lit(False))
        else:
            inner = group.kind.split(" ")[1]
            found = F.exists(group.column, lambda x: equal(item, Value(x, inner)))
        return Value(found if e[0] == "in" else ~found, "bool")

    def whole(self, var: str) -> Column:
        fields = NODE if self.vars[var] == "node" else EDGE
        return F.when(F.col(f"{var}__id").isNotNull(), F.struct(*[F.col(f"{var}__{c}").alias(c) for c in fields]))

    def exists(self, path: list) -> Column:
        """A flag column from a left join with the distinct bound ids for which the pattern holds."""
        other, shared = self.correlated(path)
        flag = self.fresh()
        marks = other.select(*[F.col(f"{n}__id").alias(f"{flag}{n}") for n in shared]).distinct().withColumn(flag, F.lit(True))
        on = functools.reduce(lambda a, b: a & b, [F.col(f"{n}__id") == F.col(f"{flag}{n}") for n in shared], F.lit(True))
        self.frame = self.frame.join(marks, on, "left").drop(*[f"{flag}{n}" for n in shared])
        return F.coalesce(F.col(flag), F.lit(False))

    def correlated(self, path: list) -> tuple[DataFrame, list[str]]:
        other = _Plan(self.graph, self.params)
        other.hidden = self.hidden + 5000
        other.match(path, False)
        return other.frame, [n for n in dict.fromkeys(p.var for p in path[::2] if p.var) if n in self.vars]

    def function(self, name: str, args: list[Value], raw: list[tuple]) -> Value:
        if name in ("id", "type", "labels", "keys", "properties"):
            var = raw[0][1] if raw and raw[0][0] == "var" else None
            kind = self.vars.get(var)
            if kind not in ("node", "edge"):
                return Value(F.array().cast("array<string>"), "list text") if name in ("labels", "keys") else Value(F.lit(None).cast("string"), "text", None)
            if name == "id":
                return Value(F.col(f"{var}__id"), "number")
            own = F.col(f"{var}__{'type' if kind == 'edge' else 'label'}")
            if name == "type":
                return Value(own, "text")
            if name == "labels":
                return Value(F.when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>")), "list text")
            extra = ["name", "qualified_name", "label", "file_path"] if kind == "node" else ["type"]
            dynamic = F.coalesce(F.json_object_keys(f"{var}__properties"), F.array().cast("array<string>"))
            if name == "keys":
                return Value(F.when(own.isNotNull(), F.array_sort(F.array_union(dynamic, F.array(*map(F.lit, extra))))), "list text")
            fixed = F.create_map(*[x for c in extra for x in (F.lit(c), F.col(f"{var}__{c}"))])
            return Value(F.map_concat(F.coalesce(F.from_json(f"{var}__properties", "map<string,string>"), F.create_map().cast("map<string,string>")), fixed), "map")
        if not args:
            raise CypherError(f"{name} needs an argument")
        v = args[0]
        if name in ("tolower", "toupper", "tostring"):
            return Value({"tolower": F.lower, "toupper": F.upper, "tostring": lambda x: x}[name](printed(v)), "text")
        if name == "tointeger":
            return Value(F.when(printed(v).rlike(r"^[+-]?\d+$"), printed(v).try_cast("bigint")), "number")
        if name == "tofloat":
            return Value(number(v), "number")
        if name in ("size", "length"):
            length = F.size(v.column) if v.kind.startswith("list") else F.char_length(v.column) if v.kind in ("text", "any") else F.lit(0)
            return Value(F.when(v.column.isNull(), 0).otherwise(length), "number")
        if name == "reverse":
            return Value(F.reverse(printed(v)), "text")
        if name == "replace":
            return Value(F.replace(printed(v), printed(args[1]), printed(args[2])), "text")
        if name in ("left", "right"):
            n = F.greatest(number(args[1]).cast("int"), F.lit(0))
            text = printed(v)
            return Value(F.when(n == 0, "").otherwise((F.left if name == "left" else F.right)(text, n)), "text")
        if name == "substring":
            text, start = printed(v), number(args[1]).cast("int")
            size = F.greatest(number(args[2]).cast("int"), F.lit(0)) if len(args) > 2 else F.char_length(text)
            return Value(F.when((start < 0) | (start >= F.char_length(text)), "").otherwise(F.substring(text, start + 1, size)), "text")
        if name == "coalesce":
            one = len({a.kind for a in args}) == 1 and v.kind == "number"
            cells = [a.column if one else F.nullif(F.when(a.column.isNotNull(), printed(a)), F.lit("")) for a in args]
            return Value(F.coalesce(*cells), "number" if one else "text")
        raise CypherError(f"unsupported function {name}")

    # Clauses

    def filter(self, e: tuple) -> None:
        """Keep the rows for which ``e`` is truthy; pattern tests among its conjuncts become semi and anti joins."""
        if e[0] == "and":
            self.filter(e[1])
            self.filter(e[2])
            return
        inner, kind = (e[1], "left_anti") if e[0] == "not" and e[1][0] == "exists" else (e, "left_semi")
        if inner[0] == "exists":
            other, shared = self.correlated(inner[1])
            keys = other.select(*[F.col(f"{n}__id").alias(f"_k{n}") for n in shared])
            on = functools.reduce(lambda a, b: a & b, [F.col(f"{n}__id") == F.col(f"_k{n}") for n in shared], F.lit(True))
            self.frame = self.frame.join(keys, on, kind)
            return
        keep = truthy(self.value(e))  # may first join a degree or a flag to the frame
        self.frame = self.frame.where(keep)

    def aggregate(self, e: tuple) -> Value:
        _, name, args, distinct = e
        if not args or args[0][0] == "star":
            if name != "count":
                raise CypherError(f"{name} needs an argument")
            return Value(F.least(F.count(F.lit(1)), F.lit(1)) if distinct and args else F.count(F.lit(1)), "number")
        v = self.value(args[0])
        cell = F.col(f"{args[0][1]}__id") if v.kind == "struct" else v.column
        if name == "count":
            return Value(F.count_distinct(cell) if distinct else F.count(cell), "number")
        if name == "collect":
            gathered = F.collect_set(v.column) if distinct else F.collect_list(v.column)
            return Value(gathered, f"list {v.kind}")
        if name in ("min", "max"):
            best = F.min if name == "min" else F.max
            if v.kind == "any":
                n = number(v)  # numbers among themselves, else by text
                return Value(F.coalesce(F.when(F.count(n) == F.count(v.column), F.regexp_replace(best(n).cast("string"), r"\.0$", "")), best(v.column)), "any")
            return Value(best(v.column), v.kind)
        n = number(v)
        if name == "sum":
            return Value(F.coalesce(F.sum_distinct(n) if distinct else F.sum(n), F.lit(0.0)), "number")
        return Value(F.avg(n) if not distinct else F.sum_distinct(n) / F.count_distinct(n), "number")

    def title(self, e: tuple, alias: str | None, place: int) -> str:
        if alias:
            return alias
        return {"var": lambda: e[1], "prop": lambda: f"{e[1]}.{e[2]}", "call": lambda: e[1]}.get(e[0], lambda: f"column_{place}")()

    def project(self, p: Projection, last: bool) -> list[str]:
        """Replace the frame by the projection; the names of its columns."""
        if p.star:
            if not last:
                return self.cut(p, sort=False)
            columns = []
            for v, kind in self.vars.items():
                if v.startswith("_") or kind not in ("node", "edge"):
                    continue
                source = {"name": f"{v}__name", "qualified_name": f"{v}__qualified_name", "label": f"{v}__label", "file_path": f"{v}__file_path"} if kind == "node" else {"name": f"{v}__type"}
                columns += [(F.col(source[c]) if c in source else F.lit("")).alias(f"{v}.{c}") for c in ("name", "qualified_name", "label", "file_path")]
            self.frame = self.frame.select(*columns)
            if p.distinct:
                self.frame = self.frame.distinct()
            return self.cut(p, sort=False)
        items = [(e, self.title(e, alias, i + 1)) for i, (e, alias) in enumerate(p.items)]
        grouped = any(is_aggregate(e) for e, _ in items)
        outs: list[tuple[str, Value, tuple]] = []
        for e, title in items:
            value = self.aggregate(e) if is_aggregate(e) else self.value(e)
            outs.append((title, value, e))
        order = []
        for e, down in p.order:
            hit = next((i for i, (t, _, ie) in enumerate(outs) if (e[0] == "var" and e[1] == t) or e == ie), None)
            if hit is None and e[0] == "prop":
                hit = next((i for i, (t, _, _) in enumerate(outs) if t == f"{e[1]}.{e[2]}"), None)
            if hit is None and is_aggregate(e):
                raise CypherError("ORDER BY an aggregate needs its alias")
            order.append((hit, None if hit is not None or grouped or p.distinct else self.value(e), down))
        keys = [f"_c{i}" for i in range(len(outs))]
        if grouped:
            group = [(k, v) for k, (_, v, e) in zip(keys, outs, strict=True) if not is_aggregate(e)]
            totals = [v.column.alias(k) for k, (_, v, e) in zip(keys, outs, strict=True) if is_aggregate(e)]
            table = self.frame.select("*", *[v.column.alias(k) for k, v in group]).groupBy(*[k for k, _ in group]).agg(*totals)
            if group:  # no rows at all still give one
                none = table.agg(F.count("*").alias("_n")).where("_n = 0")
                zeros = {"count": F.lit(0), "sum": F.lit(0.0)}
                blank = [F.lit(None).cast(table.schema[k].dataType).alias(k) if not is_aggregate(e) else zeros.get(e[1], F.array() if e[1] == "collect" else F.lit(None)).cast(table.schema[k].dataType).alias(k) for k, (_, _, e) in zip(keys, outs, strict=True)]
                table = table.select(*keys).unionByName(none.select(*blank))
            self.frame = table.select(*keys)
        else:
            carried = [] if last else [c for t, _, e in outs if e[0] == "var" and self.vars.get(e[1]) in ("node", "edge") for c in [F.col(f"{e[1]}__{f}").alias(f"_v_{t}__{f}") for f in (NODE if self.vars[e[1]] == "node" else EDGE)]]
            extra = [v.column.alias(f"_s{i}") for i, (_, v, _) in enumerate(order) if v is not None]
            self.frame = self.frame.select(*[v.column.alias(k) for k, (_, v, _) in zip(keys, outs, strict=True)], *extra, *carried)
            if p.distinct:
                self.frame = self.frame.dropDuplicates(keys)
        sorts = []
        for i, (hit, v, down) in enumerate(order):
            if hit is None and v is None:
                raise CypherError("ORDER BY needs an item of the projection here")
            kind = outs[hit][1].kind if hit is not None else v.kind
            column = F.col(keys[hit]) if hit is not None else F.col(f"_s{i}")
            sorts += [c.desc_nulls_first() if down else c.asc_nulls_last() for c in self.ranks(Value(column, kind))]
        if sorts:
            self.frame = self.frame.orderBy(*sorts)
        if p.skip:
            self.frame = self.frame.offset(p.skip)
        if p.limit:
            self.frame = self.frame.limit(p.limit)
        if last:
            self.frame = self.frame.select(*[F.col(k).alias(t) for k, (t, _, _) in zip(keys, outs, strict=True)])
        else:
            kinds, columns = {}, []
            for k, (t, v, e) in zip(keys, outs, strict=True):
                kind = self.vars.get(e[1]) if e[0] == "var" else None
                if kind in ("node", "edge"):
                    fields = NODE if kind == "node" else EDGE
                    columns += [(F.col(f"{k}.{f}") if grouped else F.col(f"_v_{t}__{f}")).alias(f"{t}__{f}") for f in fields]
                    kinds[t] = kind
                else:
                    columns.append(F.col(k).alias(t))
                    kinds[t] = v.kind
            self.frame, self.vars = self.frame.select(*columns), kinds
        return [t for t, _, _ in outs]

    def ranks(self, v: Value) -> list[Column]:
        if v.kind in ("number", "bool"):
            return [v.column]
        text = printed(v)
        return [number(v), text] if v.kind == "any" else [text]

    def cut(self, p: Projection, sort: bool) -> list[str]:
        if p.skip:
            self.frame = self.frame.offset(p.skip)
        if p.limit:
            self.frame = self.frame.limit(p.limit)
        return list(self.frame.columns)

    def run(self, q: Single) -> DataFrame:
        if q.unwind:
            items = self.value(q.unwind[0])
            if not items.kind.startswith("list"):
                raise CypherError("UNWIND needs a list")
            self.frame = self.graph.spark.range(1).select(F.explode(items.column).alias(q.unwind[1]))
            self.vars[q.unwind[1]] = items.kind.split(" ")[1]
        for optional, path in q.matches:
            self.match(path, optional)
        if self.frame is None:
            self.frame = self.graph.spark.range(1).select(F.lit(1).alias("_unit"))
        if q.where:
            self.filter(q.where)
        if q.carry:
            self.project(q.carry, last=False)
            if q.carry_where:
                self.filter(q.carry_where)
        result = q.result
        if result is None:
            nodes = [p.var for p in (q.matches[0][1][::2] if q.matches else []) if p.var and self.vars.get(p.var) == "node"]
            result = Projection([(("prop", v, f), None) for v in nodes for f in ("name", "qualified_name", "label")] if nodes else [(("var", v), None) for v in self.vars])
        self.project(result, last=True)
        return self.frame


def cypher(graph: Graph, text: str, params: dict | None = None, max_rows: int | None = None) -> DataFrame:
    """The result of a query as a DataFrame; nothing is run.

    ``max_rows`` caps the rows of a query without a LIMIT of its own. Dynamic properties come out as text.
    """
    out = None
    parts = parse(text)
    for keep_all, part in parts:
        frame = _Plan(graph, params or {}).run(part)
        if out is None:
            out = frame
            continue
        if out.columns != frame.columns:
            raise CypherError("UNION needs the same columns in the same order")
        out = out.union(frame)
        if not keep_all:
            out = out.distinct()
    limited = parts[-1][1].result is not None and parts[-1][1].result.limit
    return out.limit(max_rows) if max_rows and not limited else out


class Answer(NamedTuple):
    """``rows``, at most as many as asked for; ``total``, how many there are; ``truncated``, whether some are left out."""

    rows: DataFrame
    total: int
    truncated: bool


def answer(graph: Graph, text: str, most: int = MAX_ROWS, **parameters) -> Answer:
    """A query's rows up to ``most``, and how many there are without that limit. A limit of the query's own counts as its wish."""
    whole = cypher(graph, text, max_rows=None, **parameters)
    total = whole.count()
    return Answer(whole.limit(most), total, total > most)


def graph_of(spark: SparkSession, project_nodes: DataFrame, project_edges: DataFrame, project: str, selector: str = "code") -> Graph:
    """The graph of one project, or with ``missed`` that of what was not indexed."""
    if selector not in ("code", "missed"):
        raise CypherError(f"unknown graph {selector}")
    wanted = project if selector == "code" else f"{project}::missed"
    return Graph(project_nodes.where(F.col("project") == wanted), project_edges.where(F.col("project") == wanted))
