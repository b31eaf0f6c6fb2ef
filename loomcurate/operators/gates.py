"""Ordered gates: every row gets the reason of the first gate it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def waterfall(df: DataFrame, gates: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """Adds the name of the first gate whose condition doesn't hold, or null. A null condition counts as not holding.

    Stage gates that call Python by several waterfalls with where(reason is null) between, as Spark evaluates Python
    columns for all rows.
    """
    reason = F.lit(None).cast("string")
    for gate, holds in reversed(gates):
        reason = F.when(~F.coalesce(holds, F.lit(False)), F.lit(gate)).otherwise(reason)
    return df.withColumn(name, reason)


def funnel(df: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, rows): a count of each reason."""
    return df.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("rows"))


def all_tests_passed(score: Column, statuses: Column) -> Column:
    """Score 1 and a JSON list of at least one status, all of them "pass"; broken or null JSON doesn't pass."""
    each = F.from_json(statuses, "array<string>")
    return F.coalesce((score == 1.0) & (F.size(each) > 0) & F.forall(each, lambda s: s.eqNullSafe(F.lit("pass"))), F.lit(False))


def well_formed(question: Column, answer: Column) -> Column:
    """A non-blank question without triple quotes and an answer that is one fenced block. Aborts on null, which no source row may have."""
    q = F.when(question.isNull() | answer.isNull(), F.raise_error(F.lit("question and answer must not be null")).cast("string")).otherwise(T.strip(question))
    return (F.length(q) > 0) & ~q.contains('"""') & T.fenced_code(T.strip(answer)).isNotNull()


def in_subset(language: Column, aspect: Column, languages: list[str], aspects: list[str]) -> Column:
    """Case-insensitive membership of both; missing values count as empty."""
    folded = lambda c: T.casefold(F.coalesce(c, F.lit("")))
    return folded(language).isin([x.casefold() for x in languages]) & folded(aspect).isin([x.casefold() for x in aspects])


def first_text(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def enough_evidence(chosen: Column, rejected: Column, tests: Column, least: float = 0.5, tests_needed: int = 5) -> Column:
    """The chosen answer passes everything, the rejected one at least `least` but not all, on enough tests; missing scores fail."""
    r = F.coalesce(rejected, F.lit(1.0))
    return F.coalesce(chosen == 1.0, F.lit(False)) & (r >= least) & (r < 1) & (F.size(F.coalesce(tests, F.array().cast("array<string>"))) >= tests_needed)


def fits(prompt_tokens: Column, completion_tokens: Column, sequence: int = 1024, completion: int = 512) -> Column:
    return (prompt_tokens + completion_tokens <= sequence) & (completion_tokens <= completion)


def pair_fits(prompt_tokens: Column, chosen_tokens: Column, rejected_tokens: Column, sequence: int = 1024, completion: int = 512) -> Column:
    return fits(prompt_tokens, F.greatest(chosen_tokens, rejected_tokens), sequence, completion)


def length_reason(prompt_tokens: Column, answer_tokens: Column, limit: int = 512) -> Column:
    """prompt_over_limit for 0 or more than `limit` tokens, then reference_over_limit, else null."""
    return F.when(~prompt_tokens.between(1, limit), "prompt_over_limit").when(answer_tokens > limit, "reference_over_limit")


def excluded(df: DataFrame, exclusions: DataFrame, key: str) -> DataFrame:
    """Adds `is_excluded`: whether the row's key is on the list. Repeated and null keys of the list don't matter."""
    marks = exclusions.select(key).where(F.col(key).isNotNull()).distinct().withColumn("is_excluded", F.lit(True))
    return df.join(marks, key, "left").withColumn("is_excluded", F.coalesce("is_excluded", F.lit(False)))


def require_rows(df: DataFrame, split: str, least: dict[str, int]) -> DataFrame:
    """(split, rows) of each split; raises while running where a split has fewer rows than it needs."""
    need = F.create_map(*(F.lit(x) for kv in least.items() for x in kv))
    counts = df.sparkSession.createDataFrame([(k,) for k in least], f"{split} string").join(df.groupBy(split).agg(F.count("*").alias("n")), split, "left")
    n = F.coalesce("n", F.lit(0))
    ok = n >= F.element_at(need, F.col(split))
    return counts.select(split, F.when(ok, n).otherwise(F.raise_error(F.concat(F.lit("too few rows in "), F.col(split))).cast("long")).alias("rows"))
