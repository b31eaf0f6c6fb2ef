"""Deterministic splits, samples and orders. They follow hashes of keys, so neither file order nor partitioning changes them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: Ranges in which large groups are numbered.
RANGES = 64
#: Rows that one task may sort for a limit; larger limits are cut by counting ranges.
TOP = 1_000_000


def hash_number(text: Column) -> Column:
    """The first 32 bits of the SHA-256 of a text."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def split_of(key: Column, one_in: int = 20, salt: str = "") -> Column:
    """"valid" for one key in `one_in`, else "train". Another salt gives an independent split."""
    return F.when(hash_number(F.concat(F.lit(salt), key)) % one_in == 0, "valid").otherwise("train")


def dataset_seed(seed: int, name: str) -> int:
    """The seed of one data set among several: the seed XOR the first 32 bits of the name's SHA-256."""
    return seed ^ int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)


def dataset_seed_column(seed: int, name: Column) -> Column:
    return F.lit(seed).cast("long").bitwiseXOR(hash_number(name))


def shuffle_key(seed: int, key: str) -> Column:
    """What to order by for a seeded shuffle; the key itself breaks ties."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)


def first_rows(df: DataFrame, order: list[str | Column], limit: int, by: Column | None = None) -> DataFrame:
    """The first `limit` rows of all; up to TOP a top-k, so no full sort.

    A greater limit would gather its rows in one task. Instead rows are counted in ranges of `by`, a number that never falls
    along the order (by default the first column of the order, where that is a number): the ranges below the limit are taken
    whole, and only the one that holds it is sorted, in finer ranges where it is large. by must not be null.
    """
    if by is None and isinstance(order[0], str) and isinstance(df.schema[order[0]].dataType, NumericType):
        by = F.col(order[0])
    if limit <= TOP or by is None:
        return df.orderBy(*order).limit(limit)
    rows, low, high, left = df.withColumn("__by", by.cast("double")), float("-inf"), float("inf"), limit
    while True:
        inside = rows.where((F.col("__by") > low) & (F.col("__by") <= high))
        cuts = sorted(set(inside.approxQuantile("__by", [i / RANGES for i in range(1, RANGES)], 0.002)))
        place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("__by"))) if cuts else F.lit(0)
        counts = dict(inside.groupBy(place.alias("b")).count().collect())  # at most RANGES rows
        edges = [low, *cuts, high]
        for b in range(len(cuts) + 1):
            if counts.get(b, 0) >= left:
                break
            left -= counts.get(b, 0)
        else:
            return df  # fewer rows than the limit
        low, high = edges[b], edges[b + 1]
        if counts[b] <= TOP or counts[b] == sum(counts.values()):
            break
    edge = rows.where((F.col("__by") > low) & (F.col("__by") <= high)).orderBy(*order).limit(left)
    return rows.where(F.col("__by") <= low).unionByName(edge).drop("__by")


def sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement (those of the least seeded hashes); raises if there are fewer, for k up to TOP while running."""
    picked = first_rows(df, [shuffle_key(seed, key), F.col(key)], k, hash_number(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    if k > TOP:
        if (found := picked.count()) < k:
            raise ValueError(f"fewer than {k} rows: {found}")
        return picked
    n = F.count("*").over(Window.partitionBy(F.lit(0)))  # of at most k rows
    enough = F.when(n == k, True).otherwise(F.raise_error(F.lit(f"fewer than {k} rows")).cast("boolean"))
    return picked.withColumn("__ok", enough).where("__ok").drop("__ok")


def shuffled(df: DataFrame, key: str, seed: int, position: str = "position", within: str | None = None) -> DataFrame:
    """Adds each row's 1-based place in a seeded shuffle (of each `within`). A global numbering is exact and still distributed:
    rows are counted per bucket of the hash's first two digits, so that a place is the rows in lower buckets plus a rank."""
    h = shuffle_key(seed, key)
    if within:
        return df.withColumn(position, F.row_number().over(Window.partitionBy(within).orderBy(h, key)))
    rows = df.withColumn("__b", F.substring(h, 1, 2))
    below = rows.groupBy("__b").agg(F.count("*").alias("__n"))  # at most 256 rows
    before = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    below = below.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(h, key)))
    return ranked.join(F.broadcast(below), "__b").withColumn(position, F.col("__before") + F.col("__r")).drop("__b", "__r", "__before")


def epochs(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """(epoch, position, key): every epoch is a full permutation of the rows, each another one."""
    every = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("epoch"))
    h = F.sha2(F.concat(F.lit(f"{seed}|"), F.col("epoch").cast("string"), F.lit("|"), F.col(key).cast("string")), 256)
    rows = every.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 2))
    below = rows.groupBy("epoch", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("epoch").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    below = below.select("epoch", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("epoch", "__b").orderBy("__h", key)))
    return ranked.join(below, ["epoch", "__b"]).select("epoch", (F.col("__before") + F.col("__r") - 1).alias("position"), key)


def first_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(f"__n <= {n}").drop("__n")


def manifest(df: DataFrame, name: str, seed: int) -> DataFrame:
    """One row that describes a data set: (name, available, keys, seed)."""
    return df.agg(F.count("*").alias("available")).select(F.lit(name).alias("name"), "available", F.lit(", ".join(sorted(df.columns))).alias("keys"), F.lit(dataset_seed(seed, name)).alias("seed"))


def _number(df: DataFrame, order: str) -> Column:
    """A number that never falls along the order: the order itself, a time's microseconds, or seven bytes of a text after what all
    texts begin with; for other kinds one number for all."""
    kind = df.schema[order].dataType
    if isinstance(kind, NumericType):
        return F.col(order)
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    if not isinstance(kind, (StringType, BinaryType)):
        return F.lit(0)
    least, most = (bytes(v) if v is not None else b"" for v in df.agg(F.min(F.col(order).cast("binary")), F.max(F.col(order).cast("binary"))).first())
    shared = next((i for i, (x, y) in enumerate(zip(least, most)) if x != y), min(len(least), len(most)))
    part = F.rpad(F.hex(F.substring(F.col(order).cast("binary"), shared + 1, 7)), 14, "0")
    return F.conv(part, 16, 10).cast("long")


def in_ranges(df: DataFrame, within: str, order: str) -> DataFrame:
    """Adds `__b`, the range (of RANGES by its quantiles) of the order within each `within` that a row falls into, so that work along
    the order of one large group isn't done in one task. The order is a number or a text; nulls fall into the first range."""
    quantiles = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    rows = df.withColumn("__o", _number(df, order))
    cuts = rows.groupBy(F.col(within).alias("__within")).agg(F.array_distinct(F.percentile_approx("__o", quantiles, F.lit(10_000))).alias("__cuts"))
    rows = rows.join(cuts, F.col(within).eqNullSafe(F.col("__within")))
    return rows.withColumn("__b", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__o"))), F.lit(0))).drop("__cuts", "__o", "__within")


def beside(df: DataFrame, per_range: DataFrame, within: str) -> DataFrame:
    """df of in_ranges() with the columns that per_range (within, __b, ...) has for its range."""
    there = per_range.withColumnsRenamed({within: "__w", "__b": "__c"})
    return df.join(there, F.col(within).eqNullSafe(F.col("__w")) & (F.col("__b") == F.col("__c"))).drop("__w", "__c")


def earlier_ranges(within: str) -> Window:
    """The ranges before each one."""
    return Window.partitionBy(within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)


def ranked(df: DataFrame, within: str, order: str, position: str = "row_number") -> DataFrame:
    """Adds the 1-based place of each row by `order` within each `within`, null being a group, too.

    Rows are counted per range of the order, so that one large group isn't numbered in one task. The order is a number or a text,
    unique within its group and not null.
    """
    rows = in_ranges(df, within, order)
    counts = rows.groupBy(within, "__b").agg(F.count("*").alias("__n"))
    below = counts.select(within, "__b", F.coalesce(F.sum("__n").over(earlier_ranges(within)), F.lit(0)).alias("__before"))
    numbered = rows.withColumn("__r", F.row_number().over(Window.partitionBy(within, "__b").orderBy(order)))
    return beside(numbered, below, within).withColumn(position, F.col("__before") + F.col("__r")).drop("__b", "__r", "__before")


def batches(df: DataFrame, order: str, within: str, size: int = 16) -> DataFrame:
    """Adds `batch`: rows of each `within` in groups of `size` by order, the last one short."""
    return ranked(df, within, order, "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size)).drop("__n")
