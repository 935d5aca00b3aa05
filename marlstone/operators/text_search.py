"""Full-text search by BM25 over weighted fields.

A query of a few words reads each text once: the counts of its words are computed beside the texts, so no inverted
index is shuffled. The collection's statistics are one pre-aggregated row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def query_words(query: str) -> list[str]:
    """The distinct lower-case words of a query, sorted."""
    return sorted({w.lower() for w in re.findall(r"[^\W]+", query)})


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def split_names(text: Column) -> Column:
    """A text followed by its words cut at changes of case."""
    cut = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.concat_ws(" ", text, cut)


def bm25(df: DataFrame, fields: dict[str, float], query: str, prefix: bool = True) -> DataFrame:
    """``df`` with ``bm25`` for the rows in which a word of the query occurs (as a prefix, if ``prefix``).

    A word's count is the sum of its counts in the fields times their weights; a row's length is that of all its
    fields. A query without words matches nothing.
    """
    words = query_words(query)
    if not words:
        return df.limit(0).withColumn("bm25", F.lit(0.0))
    tokens = {c: words_of(F.col(c)) for c in fields}
    hit = (lambda w: lambda t: F.startswith(t, F.lit(w))) if prefix else (lambda w: lambda t: t == w)
    rows = df.withColumns({f"_t_{c}": t for c, t in tokens.items()})
    rows = rows.withColumn("_len", reduce(lambda a, b: a + b, [F.size(f"_t_{c}") for c in fields]))
    rows = rows.withColumns({f"_q{i}": reduce(lambda a, b: a + b, [F.lit(w) * F.size(F.filter(f"_t_{c}", hit(word))) for c, w in fields.items()]) for i, word in enumerate(words)})
    rows = rows.drop(*[f"_t_{c}" for c in fields])
    stats = rows.agg(F.count("*").alias("n"), F.avg("_len").alias("mean"), *[F.count_if(F.col(f"_q{i}") > 0).alias(f"d{i}") for i in range(len(words))]).first()
    total = F.lit(0.0)
    for i in range(len(words)):
        tf, d = F.col(f"_q{i}"), stats[f"d{i}"]
        idf = F.log1p(F.lit((stats["n"] - d + 0.5) / (d + 0.5)))
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(stats["mean"] or 1.0)))
    found = reduce(lambda a, b: a | b, [F.col(f"_q{i}") > 0 for i in range(len(words))])
    return rows.where(found).withColumn("bm25", total).drop("_len", *[f"_q{i}" for i in range(len(words))])
