"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_loaded: dict = {}


def encoder(vocabulary: str):
    """The encoding of a rank file, loaded once per process."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *extra, tokens)``, one row per non-null key; a null text has 0 tokens.

    Repeated rows of a key count once, the longest wins. Texts are read where they lie; only counts are shuffled.
    """

    def count(batches):
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], ["id", *extra, "tokens"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), *extra, F.col(text).alias("_text"))
    kinds = dict(rows.dtypes)
    counted = rows.mapInArrow(count, ", ".join(["id bigint", *[f"`{c}` {kinds[c]}" for c in extra], "tokens bigint"]))
    best = counted.groupBy("id").agg(F.max(F.struct("tokens", *extra)).alias("r"))
    return best.select("id", *[F.col(f"r.{c}").alias(c) for c in extra], F.col("r.tokens").alias("tokens"))
