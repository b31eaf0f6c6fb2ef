"""Rows that may match a set of keys, by a bitmap of fixed size, before anything wide is shuffled for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the bitmap, 64 bits each: 2^22 bits, about 1 MB broadcast, however many keys there are.
WORDS = 1 << 16


def sift(df: DataFrame, column: str, keys: DataFrame, words: int = WORDS) -> DataFrame:
    """All rows of df whose column is among the keys (one column of hashes, bigint), and some others.

    The more keys there are the more others come through, up to all; a join must follow. Null keys match nothing.
    """
    key = keys.columns[0]
    word = lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(words - 1)).cast("int")
    bit = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` & 63 as int))")
    bitmap = keys.where(F.col(key).isNotNull()).groupBy(word(F.col(key)).alias("__word")).agg(F.bit_or(bit(key)).alias("__bits"))  # at most `words` rows
    return df.withColumn("__word", word(F.col(column))).join(F.broadcast(bitmap), "__word").where(F.col("__bits").bitwiseAND(bit(column)) != 0).drop("__word", "__bits")
