"""Removal of held-out material and joins between data sets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..session import written
from .sampling import ranked

LONGEST, SHORTEST = 12, 6
WORD = re.compile("[a-z0-9_]+")
#: Grams of the held-out side go to the executors only up to so many (about 1 kB each); of more, a bitmap of 2^SIEVE_BITS bits (8 MB).
BROADCAST_GRAMS, SIEVE_BITS = 100_000, 26


def held_out_grams(tasks: DataFrame, prompt: str = "prompt") -> DataFrame:
    """(n, gram): all runs of 12 words of prompts of 12 words or more, and the whole of those of 6 to 11; distinct."""
    tokens = tasks.select(X.words(F.col(prompt)).alias("t"))
    long = tokens.where(F.size("t") >= LONGEST).select(F.lit(LONGEST).alias("n"), F.explode_outer(X.ngrams(F.col("t"), LONGEST)).alias("gram"))
    short = tokens.where((F.size("t") >= SHORTEST) & (F.size("t") < LONGEST)).select(F.size("t").alias("n"), F.array_join("t", " ").alias("gram"))
    return long.unionByName(short).distinct()


def _scan(grams: frozenset[tuple[str, ...]], kind: pa.DataType, name: str) -> Callable:
    """Keys of the texts that hold a gram. Only runs of words that occur in some gram are looked at more closely."""
    vocabulary = frozenset(w for g in grams for w in g)
    sizes = sorted({len(g) for g in grams})
    runs = re.compile(b"\x01{%d,}" % sizes[0])

    def holds(text: str | None) -> bool:
        words = WORD.findall(text.casefold()) if text else []
        for m in runs.finditer(bytes(map(vocabulary.__contains__, words))):
            a, b = m.span()
            if any(tuple(words[i : i + n]) in grams for n in sizes for i in range(a, b - n + 1)):
                return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [i for i, t in enumerate(batch.column(1).to_pylist()) if holds(t)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found, pa.int64())).cast(kind)], [name])

    return run


def _run_hashes(words: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of every run of n words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    flat = np.fromiter((_WORDS[w] for text in words for w in text), np.uint64, int(size.sum()))
    m = len(flat) - n + 1
    if m <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = (h ^ flat[i : m + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(owner[:m] == owner[n - 1 :])
    return owner[at], at - (np.cumsum(size) - size)[owner[at]], h[at]


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return value


_WORDS = _WordHashes()


def _hashed_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [g.split(" ") for g in batch.column(0).to_pylist()]
        cells = [int(_run_hashes([w], len(w))[2][0] >> np.uint64(64 - SIEVE_BITS)) for w in words]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64())], ["cell"])


def _suspects(bits: np.ndarray, sizes: list[int], kind: pa.DataType, name: str) -> Callable:
    """(key, gram) of the runs of words whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [WORD.findall(t.casefold()) if t else [] for t in batch.column(1).to_pylist()]
            rows, grams = [], []
            for n in sizes:
                text, place, h = _run_hashes(words, n)
                cell = (h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
                hit = np.flatnonzero(bits[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1))
                rows += text[hit].tolist()
                grams += [" ".join(words[t][p : p + n]) for t, p in zip(text[hit].tolist(), place[hit].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())).cast(kind), pa.array(grams, pa.string())], [name, "gram"])

    return run


def overlapping(df: DataFrame, key: str, text: str, tasks: DataFrame, prompt: str = "prompt") -> DataFrame:
    """The distinct keys of rows whose text holds a gram of a task. Null and short texts never do.

    Up to BROADCAST_GRAMS grams go to the executors, which scan the texts once and shuffle only the keys found. Of more grams a bitmap
    of fixed size goes there; runs of words, of the lengths that occur, are hashed, and those whose bit is set are joined with the
    grams themselves.
    """
    grams = held_out_grams(tasks, prompt)
    few = grams.limit(BROADCAST_GRAMS + 1).collect()  # bounded
    if not few:
        return df.select(key).limit(0)
    field = df.schema[key]
    kind = to_arrow_type(field.dataType)
    if len(few) <= BROADCAST_GRAMS:
        scan = _scan(frozenset(tuple(r["gram"].split(" ")) for r in few), kind, key)
        return df.select(key, text).mapInArrow(scan, T.StructType([T.StructField(key, field.dataType)])).distinct()
    grams = written(grams, "grams")
    sizes = sorted(r["n"] for r in grams.select("n").distinct().collect())  # SHORTEST to LONGEST
    bits = np.zeros(1 << SIEVE_BITS - 6, np.uint64)
    cells = grams.select("gram").mapInArrow(_hashed_grams, "cell long")
    words = cells.groupBy(F.shiftright("cell", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))
    for w, b in words.collect():  # at most 2^(SIEVE_BITS - 6) rows
        bits[w] = np.int64(b).astype(np.uint64)
    suspects = df.select(key, text).mapInArrow(_suspects(bits, sizes, kind, key), T.StructType([T.StructField(key, field.dataType), T.StructField("gram", T.StringType())]))
    return suspects.distinct().join(grams.select("gram").distinct(), "gram", "left_semi").select(key).distinct()


def named_like(df: DataFrame, key: str, names: Column, tasks: DataFrame, entry_point: str = "entry_point") -> DataFrame:
    """The distinct keys of rows with a function name that equals a task's, letter case and underscores aside."""
    held = tasks.select(X.plain_name(F.col(entry_point)).alias("name")).where("name <> ''").distinct()
    mine = df.select(key, F.explode_outer(names).alias("raw")).select(key, X.plain_name(F.col("raw")).alias("name"))
    return mine.join(held, "name", "left_semi").select(key).distinct()


def without_texts(df: DataFrame, text: str, held_out: DataFrame, held_text: str) -> DataFrame:
    """Rows whose normalized text isn't a held-out text. Null texts stay."""
    held = held_out.select(X.key_hash(F.col(held_text)).alias("__key")).where("__key is not null").distinct()
    return df.withColumn("__key", X.key_hash(F.col(text))).join(held, "__key", "left_anti").drop("__key")


def crosses(valid: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """valid with one flag in_train_<key> per key; one equi-join each instead of a join on alternatives."""
    for k in keys:
        marks = train.select(k).where(F.col(k).isNotNull()).distinct().withColumn(f"in_train_{k}", F.lit(True))
        valid = valid.join(marks, k, "left").withColumn(f"in_train_{k}", F.coalesce(f"in_train_{k}", F.lit(False)))
    return valid


def lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Adds an array column of another table, empty where the key is missing there. Of repeated keys the greatest value counts."""
    one = table.groupBy(key).agg(F.max(value).alias(value))
    return df.join(one, key, "left").withColumn(value, F.coalesce(value, F.array().cast(one.schema[value].dataType)))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """(key, rows) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def join_violations(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """(key) of rows without a partner or whose column differs from the partner's; a mandatory join has none."""
    r = right.select(key, F.col(column).alias("__right"), F.lit(True).alias("__there"))
    return left.select(key, column).join(r, key, "left").where(F.col("__there").isNull() | ~F.col(column).eqNullSafe(F.col("__right"))).select(key)


def coverage_gaps(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, missing_in): keys that some of the tables lack."""
    names = list(tables)
    every = None
    for name, df in tables.items():
        part = df.select(key, F.lit(name).alias("t"))
        every = part if every is None else every.unionByName(part)
    have = every.groupBy(key).agg(F.collect_set("t").alias("have"))
    return have.select(key, F.array_sort(F.array_except(F.array(*map(F.lit, names)), "have")).alias("missing_in")).where(F.size("missing_in") > 0)


def zipped(left: DataFrame, right: DataFrame, split: str, order_left: str, order_right: str) -> DataFrame:
    """Row i of each split on the left beside row i on the right; raises while running where one side is longer."""
    a, b = ranked(left, split, order_left, "__i"), ranked(right, split, order_right, "__i")
    both = a.join(b.withColumn("__r", F.lit(True)), [split, "__i"], "full_outer").withColumn("__l", F.col(order_left))
    return both.withColumn("row_number", F.when(F.col("__r").isNotNull() & F.col("__l").isNotNull(), F.col("__i")).otherwise(F.raise_error(F.lit("the sides differ in length")).cast("long"))).drop("__i", "__r", "__l")
