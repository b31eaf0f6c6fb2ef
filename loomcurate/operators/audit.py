"""Audit decisions, counters and distributions; scores of executed code are inputs, nothing is executed here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import beside, earlier_ranges, in_ranges, sample


def checked_score(score: Column) -> Column:
    """The score; raises while running unless it is a number in [0, 1]."""
    fine = score.isNotNull() & ~F.isnan(score) & score.between(0, 1)
    return F.when(fine, score.cast("double")).otherwise(F.raise_error(F.lit("a score must be a finite number from 0 to 1")).cast("double"))


def score_with(df: DataFrame, scorer: Callable[[list[str], list[list[str]]], list[float]], code: str, tests: str, batch: int = 20) -> DataFrame:
    """Adds `score` from an external scorer, called with batches of codes and their tests.

    The scorer runs untrusted code in isolation of its own. If it fails, the job fails: trouble of the infrastructure never
    becomes a score of 0. Its results are checked for number and range.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), batch):
                part = whole.iloc[at : at + batch]
                scores = scorer(list(part[code]), [list(t) if t is not None else [] for t in part[tests]])
                if len(scores) != len(part) or any(isinstance(s, bool) or not 0 <= s <= 1 for s in scores):
                    raise ValueError("the scorer gave scores of the wrong number or range")
                yield part.assign(score=[float(s) for s in scores])

    return df.mapInPandas(run, f"{fields}, score double")


def execution_accepts(reference: Column, probe: Column, example: Column) -> Column:
    """The reference passes all tests, the empty probe doesn't, and examples, if there are any, pass."""
    return F.coalesce((reference == 1.0) & (probe < 1.0) & (example.isNull() | (example == 1.0)), F.lit(False))


def quality_reasons(reference: Column, constant: Column, calls_function: Column, mutants: Column) -> Column:
    """array<string> of all faults that apply; mutants is an array of scores."""
    survive = (F.size(mutants) >= 2) & F.forall(mutants, lambda s: s == 1.0)
    return F.array_compact(
        F.array(
            F.when(~reference.eqNullSafe(F.lit(1.0)), "reference_or_example_failed"),
            F.when(constant == 1.0, "constant_output_passes_all"),
            F.when(~calls_function, "assertion_does_not_call_function"),
            F.when(survive, "all_checked_mutants_survive"),
        )
    )


def reason_counts(df: DataFrame, by: list[str], reasons: str = "reasons") -> DataFrame:
    """(by..., reason, rows): a row counts for each of its reasons, and under null if it has none."""
    return df.select(*by, F.explode_outer(reasons).alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("rows"))


def audit_counts(df: DataFrame, by: str, mutants: str = "mutants", reasons: str = "reasons") -> DataFrame:
    """(by, checked, accepted, mutants_executed, mutants_failed, without_mutation)."""
    failed = F.size(F.filter(mutants, lambda s: s < 1.0))
    return df.groupBy(by).agg(F.count("*").alias("checked"), F.count_if(F.size(reasons) == 0).alias("accepted"), F.sum(F.size(mutants)).alias("mutants_executed"), F.sum(failed).alias("mutants_failed"), F.count_if(F.size(mutants) == 0).alias("without_mutation"))


def reexecuted(df: DataFrame, key: str, seed: int, n: int, scorer: Callable[[list[str], list[list[str]]], list[float]], code: str, tests: str, stated: str) -> DataFrame:
    """(key, stated, score, matched) of n rows sampled by seed: whether a new run of the scorer gives the stated score again.

    Raises if there are fewer than n rows. A null stated score never matches.
    """
    scored = score_with(sample(df.select(key, code, tests, stated), key, n, seed), scorer, code, tests)
    return scored.select(key, stated, "score", F.coalesce(F.col(stated) == F.col("score"), F.lit(False)).alias("matched"))


def flattened(df: DataFrame, key: str, tests: str) -> DataFrame:
    """(key, at, test): one row per test of a batch, for scorers that take single tests. Null and empty lists give none."""
    return df.select(key, F.posexplode(tests).alias("at", "test"))


def regrouped(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the rows of flattened() back as lists in their order, each as long as its batch was."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v")))).alias("all")).select(key, F.col("all.v").alias("values"))


def distribution(df: DataFrame, value: Column) -> DataFrame:
    """(value, rows)."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("rows"))


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., least, median, greatest) of the values that aren't null, for groups that have any; the median is exact.

    Approximate quantiles bracket the median of each group; rows below the bracket are counted and only those inside it are ranked,
    so that no task sorts or keeps a whole group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    around = F.percentile_approx("__v", F.array(F.lit(0.49), F.lit(0.51)), F.lit(10_000))
    groups = rows.groupBy(*by).agg(F.min("__v").alias("least"), F.max("__v").alias("greatest"), F.count("*").alias("__n"), around.alias("__q"))
    same = lambda other: [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in by]
    tagged = lambda d, tag: d.withColumnsRenamed({c: f"{tag}{c}" for c in by})
    placed = rows.join(tagged(groups.select(*by, "__q"), "__g_"), same("__g_")).drop(*(f"__g_{c}" for c in by))
    below = placed.groupBy(*by).agg(F.count_if(F.col("__v") < F.col("__q")[0]).alias("__below"))
    inside = placed.where(F.col("__v").between(F.col("__q")[0], F.col("__q")[1])).select(*by, "__v")
    ranks = inside.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__v")))
    all_of = groups.join(tagged(below, "__b_"), same("__b_")).drop(*(f"__b_{c}" for c in by))
    ranks = ranks.join(tagged(all_of.select(*by, "__n", "__below"), "__r_"), same("__r_"))
    middle = ranks.where((F.col("__r") + F.col("__below")).isin(F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)))
    medians = tagged(middle.groupBy(*by).agg(F.avg("__v").alias("median")), "__m_")
    return groups.join(medians, same("__m_")).select(*by, "least", "median", "greatest")


def duplicate_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column the rows less the distinct values (nulls aside)."""
    return df.agg(*((F.count(c) - F.countDistinct(c)).alias(f"duplicate_{c}") for c in columns))


def split_overlap(df: DataFrame, split: str, key: str, a: str, b: str) -> DataFrame:
    """One row: the number of keys that both splits have."""
    per = df.where(F.col(split).isin(a, b) & F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(split).alias("n"))
    return per.agg(F.count_if(F.col("n") == 2).alias("overlap"))


def excluding(df: DataFrame, key: str, failed: Column) -> DataFrame:
    """(key, excluded): a key with any failure is excluded; null is no failure."""
    return df.groupBy(key).agg(F.bool_or(F.coalesce(failed, F.lit(False))).alias("excluded"))


def replays(original: Column, changed: Column, line: Column, column: Column, old: Column, new: Column) -> Column:
    """Whether replacing `old` at a 1-based line and 0-based column by `new` turns the original into the changed text."""
    lines = F.split(original, "(?<=\n)")
    before = F.aggregate(F.slice(lines, 1, line - 1), F.lit(0), lambda s, x: s + F.length(x))
    at = before + column
    made = F.concat(F.substring(original, F.lit(1), at), new, F.substring(original, at + F.length(old) + 1, F.length(original)))
    return F.coalesce((F.substring(original, at + 1, F.length(old)) == old) & (made == changed), F.lit(False))


def best_so_far(df: DataFrame, order: str, value: str, within: str) -> DataFrame:
    """Adds `best`, the greatest value up to each row, and `improved`, whether the row raised it. A long run is worked on in ranges."""
    rows = in_ranges(df, within, order)
    per = rows.groupBy(within, "__b").agg(F.max(value).alias("__m"))
    rows = beside(rows, per.select(within, "__b", F.max("__m").over(earlier_ranges(within)).alias("__past")), within)
    w = Window.partitionBy(within, "__b").orderBy(order)
    until = F.greatest("__past", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = F.greatest("__past", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("best", until).withColumn("improved", earlier.isNull() | (F.col(value) > earlier)).drop("__b", "__past")


def checkpoint_of_best(df: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """(run, step, value) with the greatest value; the earliest step among equals."""
    return df.groupBy(run).agg(F.max_by(F.struct(step, value), F.struct(F.col(value), -F.col(step))).alias("r")).select(run, "r.*")


def checkpoint_of_least(df: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """(run, step, loss) with the least loss; the earliest step among equals."""
    return df.groupBy(run).agg(F.min_by(F.struct(step, loss), F.struct(loss, step)).alias("r")).select(run, "r.*")


def rollout_tallies(df: DataFrame, run: str, group: str, reward: str, truncated: Column) -> DataFrame:
    """(run, groups, zero_variance, effective, truncated): groups whose rewards are all equal teach nothing."""
    per = df.groupBy(run, group).agg((F.max(reward) - F.min(reward)).alias("range"), F.count_if(truncated).alias("t"))
    return per.groupBy(run).agg(F.count("*").alias("groups"), F.count_if(F.col("range") == 0).alias("zero_variance"), F.count_if(F.col("range") > 0).alias("effective"), F.sum("t").alias("truncated"))


def running_tallies(df: DataFrame, run: str, group: str, reward: str) -> DataFrame:
    """(run, group, zero_variance_so_far, effective_so_far): the tallies after each group, in order. A long run is worked on in ranges."""
    per = in_ranges(df.groupBy(run, group).agg((F.max(reward) - F.min(reward)).alias("range")), run, group)
    kinds = {"zero_variance_so_far": F.col("range") == 0, "effective_so_far": F.col("range") > 0}
    sums = per.groupBy(run, "__b").agg(*(F.count_if(c).alias(f"__{k}") for k, c in kinds.items()))
    past = sums.select(run, "__b", *(F.coalesce(F.sum(f"__{k}").over(earlier_ranges(run)), F.lit(0)).alias(f"__{k}") for k in kinds))
    w = Window.partitionBy(run, "__b").orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    return beside(per, past, run).select(run, group, *((F.col(f"__{k}") + F.count_if(c).over(w)).alias(k) for k, c in kinds.items()))
