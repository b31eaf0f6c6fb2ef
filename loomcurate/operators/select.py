"""Selections that depend on what was accepted before, in a stated order, without a sequential pass."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..session import drop_written, written
from ..sources.tables import DataError
from .sampling import first_rows

#: Rounds of greedy() after which every other one goes through the first IN_ORDER undecided rows one by one.
ROUNDS, IN_ORDER = 16, 200_000
#: Tables of accepted rows, one a round, before they become one.
PARTS = 8


def first_accepted(df: DataFrame, key: str, order: str, acceptable: Column, rejected_as: str, duplicate_as: str, name: str = "reason") -> DataFrame:
    """Adds a reason: duplicates are judged against the first *acceptable* row of their key, so a rejected first row shadows nothing.

    Null keys are one key. Ties of the order are duplicates of none. Both sides of the join work out df, so keys that take long
    to work out should be written first.
    """
    ok = F.coalesce(acceptable, F.lit(False))
    firsts = df.groupBy(key).agg(F.min(F.when(ok, F.col(order))).alias("__first"))
    joined = df.join(firsts.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.withColumn(name, F.when(F.col(order) > F.col("__first"), duplicate_as).when(~ok, rejected_as)).drop("__key", "__first")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds `is_first`: whether the row is the first of its key, whatever happens to it later."""
    firsts = df.groupBy(key).agg(F.min(order).alias("__first"))
    joined = df.join(firsts.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.withColumn("is_first", F.col(order) == F.col("__first")).drop("__key", "__first")


def capped(df: DataFrame, key: str, order: list[str], cap: int) -> DataFrame:
    """The first `cap` rows of each key. Spark cuts each partition's groups to the cap before it shuffles them."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(f"__n <= {cap}").drop("__n")


def _in_order(uniques: int, caps: list[int]) -> Callable:
    """Goes through rows (order, unique keys, capped keys, counts of the capped keys) one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set] = [set() for _ in range(uniques)]
        added: list[dict] = [{} for _ in caps]
        for batch in batches:
            accepted = []
            for row in zip(*(c.to_pylist() for c in batch.columns[1:])):
                keys, counted, counts = row[:uniques], row[uniques : uniques + len(caps)], row[uniques + len(caps) :]
                ok = not any(k in s for k, s in zip(keys, seen)) and all(n + a.get(k, 0) < cap for k, n, a, cap in zip(counted, counts, added, caps))
                if ok:
                    for k, s in zip(keys, seen):
                        s.add(k)
                    for k, a in zip(counted, added):
                        a[k] = a.get(k, 0) + 1
                accepted.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(accepted, pa.bool_())], [batch.schema.names[0], "settled"])

    return run


def _digest(key: Column) -> Column:
    """128 bits for a key of any kind; null is a key of its own."""
    return F.coalesce(F.unhex(F.md5(F.to_json(F.struct(key.alias("k"))))), F.lit(b""))


def greedy(df: DataFrame, order: str, unique: list[str], caps: dict[str, int] | None = None) -> DataFrame:
    """(order, accepted): the result of going through the rows in order and accepting a row if none of its `unique` keys was
    accepted before and each capped key was accepted fewer than its cap.

    order must be unique and not null. Null keys equal each other. Works in rounds instead: a row is accepted once it is the
    first undecided row of all its unique keys and among the first of each capped key that still has room; the rows that share
    a key with it, and those of capped keys without room, are rejected and leave. Every round decides at least the first
    undecided row, and in practice most of them; a round handles undecided rows only, as (order, digests of the keys), in
    aggregations that combine before the shuffle. Chains of rows, each of which waits for the one before, would take a round a
    row: after ROUNDS rounds, every other one has one task go through the first IN_ORDER undecided rows, until all are decided.
    """
    caps = caps or {}
    us, cs = [f"u{i}" for i in range(len(unique))], [f"c{i}" for i in range(len(caps))]
    rows = written(df.select(order, *(_digest(F.col(k)).alias(u) for k, u in zip(unique, us)), *(_digest(F.col(k)).alias(c) for k, c in zip(caps, cs))), "greedy")
    accepted: list[DataFrame] = []
    undecided, left = rows, rows.count()
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    both = lambda a, b: a & b
    for turn in itertools.count():
        if not left:
            break
        marked = undecided
        for u in us:
            marked = marked.join(undecided.groupBy(u).agg(F.min(order).alias(f"first_{u}")), u)
        for c in cs:
            marked = marked.join(union(accepted).groupBy(c).agg(F.count("*").alias(f"n_{c}")), c, "left") if accepted else marked.withColumn(f"n_{c}", F.lit(0).cast("long"))
            marked = marked.withColumn(f"n_{c}", F.coalesce(f"n_{c}", F.lit(0)))
        if turn >= ROUNDS and (turn - ROUNDS) % 2 == 0:
            head = marked.orderBy(order).limit(IN_ORDER).coalesce(1).sortWithinPartitions(order).select(order, *us, *cs, *(f"n_{c}" for c in cs))
            settled = head.mapInArrow(_in_order(len(us), list(caps.values())), StructType([StructField(order, df.schema[order].dataType), StructField("settled", BooleanType())]))
            decided = marked.join(settled, order, "left")
        else:
            yes = [F.col(f"first_{u}") == F.col(order) for u in us]
            for c, cap in zip(cs, caps.values()):
                ranked = undecided.withColumn("r", F.row_number().over(Window.partitionBy(c).orderBy(order))).where(f"r <= {cap}").select(order, F.col("r").alias(f"r_{c}"))
                marked = marked.join(ranked, order, "left")
                yes.append(F.coalesce(F.col(f"r_{c}") + F.col(f"n_{c}") <= cap, F.lit(False)))
            decided = marked.withColumn("settled", F.when(functools.reduce(both, yes, F.lit(True)), True))
        done = written(decided.select(order, *us, *cs, "settled"), "round")
        accepted.append(written(done.where("settled").select(order, *us, *cs), "accepted"))
        rest = done.where("settled is null").drop("settled")
        for u in us:
            rest = rest.join(accepted[-1].select(u).distinct(), u, "left_anti")
        for c, cap in zip(cs, caps.values()):
            rest = rest.join(union(accepted).groupBy(c).agg(F.count("*").alias("n")).where(f"n >= {cap}").select(c), c, "left_anti")
        rest = written(rest.select(order, *us, *cs), "undecided")
        before, left = left, rest.count()
        if left == before:
            raise ValueError(f"{order} isn't unique and not null")
        drop_written(done)
        if undecided is not rows:
            drop_written(undecided)
        undecided = rest
        if len(accepted) > PARTS:
            whole = written(union(accepted), "accepted")
            for part in accepted:
                drop_written(part)
            accepted = [whole]
    taken = union([p.select(order) for p in accepted] or [rows.select(order).limit(0)]).withColumn("accepted", F.lit(True))
    return rows.select(order).join(taken, order, "left").select(order, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def greedy_reasons(df: DataFrame, order: str, unique: dict[str, str], caps: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """df with `reason`: null where greedy() accepts; else the name given to the first unique key, then cap, that was taken before."""
    caps = caps or {}
    chosen = greedy(df, order, list(unique), {k: c for k, (c, _) in caps.items()})
    joined = df.join(chosen, order)
    taken = joined.where("accepted")
    reason = F.lit(None).cast("string")
    for k, (_, name) in caps.items():
        reason = F.lit(name)
    for k, name in reversed(unique.items()):
        first = taken.groupBy(F.col(k).alias("__k")).agg(F.min(order).alias(f"__first_{k}"))
        joined = joined.join(first, F.col(k).eqNullSafe(F.col("__k")), "left").drop("__k")
        reason = F.when(F.col(f"__first_{k}") < F.col(order), name).otherwise(reason)
    return joined.withColumn("reason", F.when(F.col("accepted"), F.lit(None)).otherwise(reason)).drop("accepted", *(f"__first_{k}" for k in unique))


def split_selection(df: DataFrame, split: str, order: str, unique: list[str], entry: str, targets: dict[str, int], cap: int = 5, allow_short: bool = False) -> DataFrame:
    """Selects each split in the order of `targets`: unique keys over all splits, at most `cap` rows per entry within a split, no entry
    of the first split in later ones, the target each. df holds only rows that may be accepted.

    A split that misses its target raises, as no rule is relaxed to fill it; allow_short returns what there is.
    """
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(targets) for x in (s, i)))
    rows = df.withColumn("__rank", F.element_at(rank, F.col(split))).where("__rank is not null").withColumn("__capped", F.struct(split, entry))
    first, others = list(targets)[0], list(targets)[1:]
    out = chosen = capped_to = None
    for s, target in targets.items():
        part = rows.where(F.col(split) == s)
        if chosen is not None:
            part = part.join(chosen.select(entry).where(F.col(split) == first).distinct(), entry, "left_anti")
            for u in unique:
                part = part.join(chosen.select(u).distinct(), u, "left_anti")
        kept = part.join(greedy(part, order, unique, {entry: cap}).where("accepted").select(order), order)
        kept = written(first_rows(kept, [order], target).drop("__rank", "__capped"), "selected")
        if not allow_short and (n := kept.count()) < target:
            raise DataError(f"{s} has {n} acceptable rows of {target}")
        out = kept if out is None else out.unionByName(kept)
        chosen = out
    return out


def recapped(df: DataFrame, split: str, entry: str, order: str, train: str = "train", valid: str = "valid", cap: int = 5) -> DataFrame:
    """Train rows without an entry of valid, then the first `cap` of each entry; valid rows all. Rows removed first use up no cap."""
    held = df.where(F.col(split) == valid).select(entry).distinct()
    kept = capped(df.where(F.col(split) == train).join(held, entry, "left_anti"), entry, [order], cap)
    return kept.select(df.columns).unionByName(df.where(F.col(split) == valid))


def best_candidate(df: DataFrame, key: str, score: str, index: str) -> DataFrame:
    """Per key the candidate with the greatest score, the least index among equals."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(index))).alias("r")).select(key, "r.*")
