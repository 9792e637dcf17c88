"""Sharding by a Feistel permutation of the global row numbers, walked until it stays within the rows.

The permutation of 0..n-1 is a keyed bijection that anyone can compute for one row without looking at the others:
``shard = permuted % shards`` and ``slot = permuted // shards``. Shard sizes differ by at most one row and slots have no
gaps. The same seed and rows give the same order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import numbered

ROUNDS = 6
#: Fixed values of the round function.
MULTIPLIER, SHIFT, _KEY_STEP, _KEY_MODULUS = 2654435761, 15, 40503, 2147483647


def half_bits(rows: int) -> int:
    """Bits of one half of the smallest even-width domain that holds all row numbers (under four times as many)."""
    return max(1, -(-(max(rows, 1) - 1).bit_length() // 2))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [((seed + 1) * _KEY_STEP * (r + 1) + r * r + 12345) % _KEY_MODULUS for r in range(rounds)]


def permute(numbers: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """Images of row numbers below ``rows``; a bijection of 0..rows-1 (rows below 2**60)."""
    bits = half_bits(rows)
    mask, keys = np.uint64((1 << bits) - 1), [np.uint64(k) for k in round_keys(seed)]
    out, outside = numbers.astype(np.uint64), np.ones(len(numbers), dtype=bool)
    while outside.any():
        x = out[outside]
        left, right = x >> np.uint64(bits), x & mask
        for key in keys:
            mixed = (right ^ key) * np.uint64(MULTIPLIER) % np.uint64(1 << 61)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(SHIFT))) & mask)
        out[outside] = (left << np.uint64(bits)) | right
        outside = out >= np.uint64(rows)
    return out.astype(np.int64)


def shuffled(number: Column, rows: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def image(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), rows, seed))

    return image(number)


def assign(df: DataFrame, order: list[Column], shards: int = 24, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` and ``slot``. ``order`` numbers the rows; rows that tie in it are interchangeable, so give
    every column that matters. Column names ``shard`` and ``slot`` of the input are replaced. An empty table stays empty.
    """
    placed = numbered(df.drop("shard", "slot"), order, "_number")
    rows = placed.count()
    return (placed.withColumn("_image", shuffled(F.col("_number"), rows, seed))
            .withColumn("shard", (F.col("_image") % shards).cast("int"))
            .withColumn("slot", F.floor(F.col("_image") / F.lit(shards)).cast("long")).drop("_number", "_image"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *extra, size, text_crc32, law, shard, slot, grown_shard) of every row; size is the text's UTF-8 bytes plus 8.

    The law is ``rows``: equal texts are spread like others, as counts at most one apart ask for. A null text has size 8
    and checksum 0, as an empty one; null ids sort first; repeated rows get slots of their own.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", *extra, (F.octet_length(text).cast("long") + 8).alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = assign(slim, [F.col(c) for c in ("doc_id", "text_crc32", "size", *extra)], shards, seed)
    return out.select("doc_id", *extra, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
