"""Edges and nodes that follow from others: resolving names, configuration links, routes, similar code, query seeds."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import written

# Confidences of the ways a name is resolved and configuration is linked; words a question is not about.
CONFIDENCE = {"import_map": 0.95, "same_module": 0.9, "qualified_suffix": 0.9, "unique_name": 0.75, "suffix_match": 0.55}
MOST_CANDIDATES = 256
CONFIG_EXACT, CONFIG_CONTAINED = 0.85, 0.75
STOP_WORDS = frozenset(
    "a an as at be by do does did how what when where which who whom why is are was were am can could should would will shall may might must of on or if in to it its has have had the and but not for from with "
    "without into onto off that this these those there here their them they about any all some work works working please explain show tell "
    "me you your we our calls callers callee uses using find trace path configure load register".split()
)


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``(call_id, qualified_name, strategy, confidence, candidates)`` for ``calls(call_id, module, callee)``.

    ``symbols(qualified_name)`` are what may be called, ``imports(module, alias, target)`` what a module imports. In
    order: an import of the callee's first part, a symbol of the same module, the only symbol of the last part's
    name, the only one ending in the whole callee, and the first by name at a confidence that falls with the number
    of candidates. A name of more than 256 candidates, or of none, is not resolved. A candidate out of reach of the
    module's imports, if it has any, counts half.
    """
    first, rest = F.split_part("callee", F.lit("."), F.lit(1)), F.regexp_replace("callee", r"^[^.]*\.?", "")
    base = calls.select("call_id", "module", "callee", first.alias("first"), rest.alias("rest"), F.substring_index("callee", ".", -1).alias("last"))
    known = symbols.select("qualified_name").distinct()
    joined = base.join(imports.select("module", F.col("alias").alias("first"), "target"), ["module", "first"], "left")
    given = F.col("target").isNotNull()
    ways = [
        ("import_map", F.when(F.col("rest") == "", F.col("target")).otherwise(F.concat_ws(".", "target", "rest")), given),
        ("import_map", F.concat_ws(".", "target", "first"), given & (F.col("rest") == "")),
        ("same_module", F.concat_ws(".", "module", "callee"), F.lit(True)),
        ("same_module", F.concat_ws(".", "module", "rest"), F.col("rest") != ""),
    ]
    structs = [F.struct(F.lit(i).alias("rank"), q.alias("q"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(name).alias("s")) for i, (name, q, ok) in enumerate(ways)]
    tries = joined.select("call_id", F.explode(F.array(*structs)).alias("t")).where("t.ok").select("call_id", "t.rank", F.col("t.q").alias("qualified_name"), F.col("t.s").alias("strategy"))
    exact = tries.join(known, "qualified_name").select("call_id", "rank", "qualified_name", "strategy", F.lit(1).cast("bigint").alias("candidates"), F.lit(True).alias("near"))
    named = known.withColumn("last", F.substring_index("qualified_name", ".", -1))
    counts = named.groupBy("last").agg(F.count("*").alias("candidates")).where(F.col("candidates") <= MOST_CANDIDATES)
    reach = imports.groupBy("module").agg(F.collect_set("target").alias("targets"))
    pool = base.join(counts, "last").join(named, "last").join(reach, "module", "left")
    near = F.col("targets").isNull() | F.exists("targets", lambda t: F.startswith("qualified_name", t))
    suffix = F.endswith("qualified_name", F.concat(F.lit("."), "callee")) & F.contains("callee", F.lit("."))
    rank = F.when(F.col("candidates") == 1, 4).when(suffix, 5).when(near & F.col("targets").isNotNull(), 6).otherwise(7)
    loose = pool.select("call_id", rank.alias("rank"), "qualified_name", F.when(F.col("candidates") == 1, "unique_name").when(suffix, "qualified_suffix").otherwise("suffix_match").alias("strategy"), "candidates", near.alias("near"))
    best = exact.unionByName(loose).groupBy("call_id").agg(F.min(F.struct("rank", "qualified_name", "strategy", "candidates", "near")).alias("b")).select("call_id", "b.*")
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])[F.col("strategy")]
    crowded = F.when((F.col("strategy") == "suffix_match") & (F.col("candidates") > 3), 3 / F.col("candidates")).otherwise(1.0)
    halved = F.when(F.col("strategy").isin("unique_name", "suffix_match") & ~F.col("near"), 0.5).otherwise(1.0)
    return best.select("call_id", "qualified_name", "strategy", (sure * crowded * halved).alias("confidence"), "candidates")


def config_key(name: str | Column) -> Column:
    """The words of a configuration key, in lower case and joined by ``_``: cut at case changes, dots, dashes and blanks."""
    cut = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(cut, "^_+|_+$", ""))


def config_links(keys: DataFrame, code: DataFrame) -> DataFrame:
    """``(key, symbol, confidence)``: keys of configuration files and code names that are the same words, or hold each other.

    Keys need two words of three letters or more. Containment goes through an equi-join on every run of words of the
    code name, so no pair is compared that does not link.
    """
    words = F.split("n", "_")
    good = keys.select(F.col("name").alias("key"), config_key("name").alias("n")).where((F.size(words) >= 2) & F.forall(words, lambda w: F.length(w) >= 3))
    names = code.select(F.col("name").alias("symbol"), config_key("name").alias("n")).where("n <> ''")
    runs = names.select("symbol", "n", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(i, F.size(words)), lambda j: F.array_join(F.slice(words, i, j - i + 1), "_"))))).alias("run"))
    found = good.join(runs.withColumnRenamed("n", "whole"), F.col("n") == F.col("run"))
    return found.groupBy("key", "symbol").agg(F.max(F.when(F.col("n") == F.col("whole"), CONFIG_EXACT).otherwise(CONFIG_CONTAINED)).alias("confidence"))


def overrides(methods: DataFrame, inherits: DataFrame) -> DataFrame:
    """``(child, parent, method)``: methods a type has that a type it inherits from or implements has too."""
    pairs = inherits.select("child", "parent").distinct()
    return pairs.join(methods.toDF("child", "method"), "child").join(methods.toDF("parent", "method"), ["parent", "method"]).select("child", "parent", "method").distinct()


def routes(code: DataFrame) -> DataFrame:
    """``(path, line, method, route)``: routes that lines of ``code(path, line, text)`` register, by their common forms."""
    form = r"\.(?i:(get|post|put|delete|patch|handle|handlefunc|route))\(\s*[\"'`](/[^\"'`]*)[\"'`]"
    rows = code.where(F.col("text").rlike(form))
    verb = F.upper(F.regexp_extract("text", form, 1))
    return rows.select("path", "line", F.when(verb.isin("HANDLE", "HANDLEFUNC", "ROUTE"), "ANY").otherwise(verb).alias("method"), F.regexp_extract("text", form, 2).alias("route"))


def query_terms(question: str) -> list[str]:
    """What a question is about, each word once: dotted names whole and in parts, and words of more than two letters.

    Common words are left out, unless nothing else is left.
    """
    terms: dict[str, None] = {}
    for piece in question.lower().split():
        bare = piece.strip("\"'`")
        dotted = "." in bare
        if dotted:
            terms[bare] = None
        terms |= dict.fromkeys(w for w in re.findall(r"\w+", bare) if dotted or len(w) > 2)
    content = [t for t in terms if "." in t or (t not in STOP_WORDS and len(t) > 2)]
    return content or list(terms)


def seeds(nodes: DataFrame, question: str, most: int = 3, gap: float = 0.2) -> DataFrame:
    """``(id, qualified_name, score)``: the nodes a question most likely names, at most ``most`` and none below ``gap`` of the best.

    A term that is the name counts 1000, its beginning 100, inside it 1, times the term's rarity; the sum counts by
    the square of the share of terms met.
    """
    terms = query_terms(question)
    if not terms:
        return nodes.limit(0).select("id", "qualified_name", F.lit(0.0).alias("score"))
    name = F.lower("name")
    tier = lambda t: F.when(name == t, 1000.0).when(F.startswith(name, F.lit(t)), 100.0).when(F.contains(name, F.lit(t)), 1.0).otherwise(0.0)
    stats = nodes.agg(F.count("*").alias("n"), *[F.count_if(F.contains(name, F.lit(t))).alias(f"d{i}") for i, t in enumerate(terms)]).first()
    idf = [float(np.log(1 + stats["n"] / max(1, stats[f"d{i}"])) + 1) for i in range(len(terms))]
    total = reduce(lambda a, b: a + b, [tier(t) * w for t, w in zip(terms, idf, strict=True)])
    met = reduce(lambda a, b: a + b, [F.when(tier(t) > 0, 1).otherwise(0) for t in terms])
    scored = nodes.select("id", "qualified_name", "name", (total * F.pow(met / len(terms), 2) + F.when(F.col("label").isin("Function", "Method"), 0.01).otherwise(0.0)).alias("score")).where(F.col("score") >= 1)
    once = scored.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "qualified_name"))).where("_n = 1")
    top = once.orderBy(F.desc("score"), "qualified_name").limit(most)
    return top.withColumn("_best", F.max("score").over(Window.partitionBy())).where(F.col("score") >= gap * F.col("_best")).select("id", "qualified_name", "score")


SLOTS, BANDS = 64, 32


def similar_code(df: DataFrame, least: float = 0.95, cap: int = 10) -> DataFrame:
    """``(source, target, similarity)``, source < target, of ``df(qualified_name, tokens)`` by 64 min-hashes of token triples.

    Only token lists of 30 or more with 32 or more different triples count. Fingerprints meet in 32 bands of two; equal
    fingerprints are one class, so copies do not fill the bands. At most ``cap`` links of each source, the most
    similar first.
    """
    good = df.where((F.size("tokens") >= 30) & F.col("qualified_name").isNotNull())

    def fingerprint(batches):
        seeds_ = (np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for batch in batches:
            names, prints = [], []
            for name, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                triples = {" ".join(map(str, tokens[i : i + 3])) for i in range(len(tokens) - 2)}
                if len(triples) < 32:
                    continue
                base = np.array([xxhash.xxh3_64_intdigest(t) for t in triples], np.uint64)
                with np.errstate(over="ignore"):
                    mixed = base[:, None] * seeds_[None, :]
                    prints.append((mixed ^ (mixed >> np.uint64(29))).min(axis=0).view(np.int64))
                names.append(name)
            flat = np.concatenate(prints) if prints else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SLOTS, dtype=np.int32)), pa.array(flat))], ["name", "print"])

    prints = written(good.select("qualified_name", "tokens").mapInArrow(fingerprint, "name string, print array<bigint>"), "prints")
    classes = written(prints.groupBy("print").agg(F.min("name").alias("head")), "printclasses")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.element_at("print", i * 2 + 1), F.element_at("print", i * 2 + 2)))
    banded = classes.select("head", "print", F.explode(bands).alias("band"))
    equal = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / SLOTS
    met = banded.toDF("a", "pa", "band").join(banded.toDF("b", "pb", "band"), "band").where("a < b").withColumn("similarity", equal("pa", "pb")).where(F.col("similarity") >= least).select("a", "b", "similarity").distinct()
    member = prints.join(classes, "print").select("head", "name")
    own = classes.select(F.col("head").alias("a"), F.col("head").alias("b"), F.lit(1.0).alias("similarity"))
    both = met.unionByName(own).join(member.toDF("a", "x"), "a").join(member.toDF("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), "similarity").distinct()
    order = Window.partitionBy("source").orderBy(F.desc("similarity"), "target")
    return both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")
