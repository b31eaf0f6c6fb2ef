"""Scores of evaluation runs, comparisons of runs, and checks of their records.

An attempt has a task, two statuses (base tests and added tests) and belongs to a stage. It passes only if both say "pass"; a
null status doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSITIONS = ("lost", "gained", "both_pass", "both_fail")


def passed(base: Column, plus: Column) -> Column:
    return base.eqNullSafe(F.lit("pass")) & plus.eqNullSafe(F.lit("pass"))


def attempts_of(documents: DataFrame, column: str = "eval") -> DataFrame:
    """(task_id, attempt, ...fields) of judge documents that map a task to its attempts."""
    each = documents.select(F.explode(column).alias("task_id", "attempts"))
    return each.select("task_id", F.posexplode("attempts").alias("attempt", "r")).select("task_id", "attempt", *(F.col(f"r.{f}").alias(f) for f in documents.schema[column].dataType.valueType.elementType.names if f != "task_id"))


def pass_at_1(attempts: DataFrame, by: list[str], task: str = "task_id", strict: bool = True) -> DataFrame:
    """(by..., passed, base_passed, total, pass_at_1). strict: raises while running where a task has more than one attempt."""
    ok = passed(F.col("base_status"), F.col("plus_status"))
    per_task = attempts.groupBy(*by, task).agg(F.count("*").alias("n"), F.count_if(ok).alias("p"), F.count_if(F.col("base_status") == "pass").alias("b"))
    if strict:
        per_task = per_task.withColumn("p", F.when(F.col("n") == 1, F.col("p")).otherwise(F.raise_error(F.lit("a task has several attempts")).cast("long")))
    sums = per_task.groupBy(*by).agg(F.sum("p").alias("passed"), F.sum("b").alias("base_passed"), F.sum("n").alias("total"))
    return sums.withColumn("pass_at_1", F.col("passed") / F.col("total"))


def by_stage(scores: DataFrame, stages: list[str], suites: list[str], value: str = "pass_at_1") -> DataFrame:
    """One row per stage in the given order with a column per suite; raises while running if a stage lacks scores."""
    order = F.array(*map(F.lit, stages))
    wide = scores.groupBy("stage").pivot("suite", suites).agg(F.first(value))
    every = scores.sparkSession.createDataFrame([(s,) for s in stages], "stage string").join(wide, "stage", "left")
    there = F.coalesce(*(F.col(f"`{s}`") for s in suites)).isNotNull()
    checked = F.when(there, F.array_position(order, F.col("stage"))).otherwise(F.raise_error(F.concat(F.lit("no scores of stage "), F.col("stage"))).cast("long"))
    return every.withColumn("position", checked).orderBy("position")


def transition(before: Column, after: Column) -> Column:
    return F.when(before & ~after, "lost").when(~before & after, "gained").when(before & after, "both_pass").otherwise("both_fail")


def paired(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """(by..., before, after, transition) of the attempts that both runs have."""
    flag = lambda df, name: df.select(*by, passed(F.col("base_status"), F.col("plus_status")).alias(name))
    return flag(before, "before").join(flag(after, "after"), by).withColumn("transition", transition(F.col("before"), F.col("after")))


def transition_counts(pairs: DataFrame, by: str = "suite") -> DataFrame:
    """(by, lost, gained, both_pass, both_fail), zeros included."""
    return pairs.groupBy(by).agg(*(F.count_if(F.col("transition") == t).alias(t) for t in TRANSITIONS))


def case_order(transition_column: Column, suite: Column, task: Column) -> list[Column]:
    """Lost cases first, then by suite and the number at the end of the task's id."""
    return [(transition_column != "lost").cast("int"), suite, F.split_part(task, F.lit("/"), F.lit(2)).try_cast("int"), task]


def stage_position(stage: Column, stages: list[str]) -> Column:
    """1-based place in a stated order; 0 for others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, stages)), stage), F.lit(0))


def _solutions(df: DataFrame, run: str, tag: str) -> DataFrame:
    """(run, task_id, count, digest): the digest is the same for the same solutions, nulls included, in any order."""
    digest = F.sum(F.xxhash64(F.coalesce("solution", F.lit("\0null")), F.length("solution")).cast("decimal(38,0)"))
    return df.groupBy(run, "task_id").agg(F.count("*").alias(f"n_{tag}"), digest.alias(f"digest_{tag}"))


def run_checks(samples: DataFrame, judged: DataFrame, tasks: DataFrame, run: str, runs: list | None = None) -> DataFrame:
    """(run, check, violations): tasks without a sample or verdict, unknown tasks, several attempts, and tasks whose solutions, all
    attempts of each side together, differ from the judged ones. runs: those that must be there, so that one without any sample shows."""
    expected = tasks.select("task_id").distinct().count()
    known = tasks.select("task_id").distinct().withColumn("known", F.lit(True))
    every = _solutions(samples, run, "sampled").join(_solutions(judged, run, "judged"), [run, "task_id"], "full_outer").join(known, "task_id", "left")
    sampled, judged_too = F.col("n_sampled").isNotNull(), F.col("n_judged").isNotNull()
    checks = {
        "missing_sample": F.lit(expected) - F.count_if(F.col("known") & sampled),
        "missing_verdict": F.lit(expected) - F.count_if(F.col("known") & judged_too),
        "unknown_task": F.count_if(F.col("known").isNull()),
        "several_attempts": F.count_if((F.col("n_sampled") > 1) | (F.col("n_judged") > 1)),
        "other_solution": F.count_if(sampled & judged_too & ~F.col("digest_sampled").eqNullSafe(F.col("digest_judged"))),
    }
    found = every.groupBy(run).agg(*(c.alias(k) for k, c in checks.items()))
    if runs is not None:
        blank = {k: expected if k.startswith("missing") else 0 for k in checks}
        found = tasks.sparkSession.createDataFrame([(r,) for r in runs], f"{run} {samples.schema[run].dataType.simpleString()}").join(found, run, "full_outer").fillna(blank)
    return found.unpivot([run], list(checks), "check", "violations")


#: The decoding that runs must share to be compared.
GREEDY = {"do_sample": False, "max_new_tokens": 512}


def record_checks(configs: DataFrame, summaries: DataFrame, counts: DataFrame, evaluation_hash: str, run: str, generation: dict[str, object] = GREEDY) -> DataFrame:
    """(run, check, violations) of the records of runs.

    configs: a row per run with stage, eval_sha256, limit_per_suite (null: none) and the fields of `generation`. summaries: a row per run
    and suite with stage, eval_sha256, passed, total and pass_at_1. counts: passed and total per run and suite, counted from the
    verdicts. Checks: the stage isn't the run's in either record; the evaluation isn't the stated one; the run is limited or decodes
    in another way; passed, total or their quotient differ from the counts, or one side lacks the suite. Runs that any of the three
    has are checked; a missing record violates its checks.
    """
    everywhere = configs.select(run).union(summaries.select(run)).union(counts.select(run)).distinct()
    differs = lambda c, v: ~F.col(c).eqNullSafe(v)
    other_decoding = F.lit(False)
    for field, value in generation.items():
        other_decoding = other_decoding | differs(field, F.lit(value))
    c = everywhere.join(configs.withColumn("__there", F.lit(True)), run, "left")
    no_record = F.col("__there").isNull()
    config = c.groupBy(run).agg(
        F.count_if(no_record | differs("stage", F.col(run))).alias("config_stage"),
        F.count_if(no_record | differs("eval_sha256", F.lit(evaluation_hash))).alias("config_evaluation"),
        F.count_if(no_record | F.col("limit_per_suite").isNotNull()).alias("limited"),
        F.count_if(no_record | other_decoding).alias("decoding"),
    )
    recount = counts.select(run, "suite", F.col("passed").alias("__p"), F.col("total").alias("__t"), F.lit(True).alias("__counted"))
    s = everywhere.join(summaries.withColumn("__there", F.lit(True)).join(recount, [run, "suite"], "full_outer"), run, "left")
    no_side = no_record | F.col("__counted").isNull()
    summary = s.groupBy(run).agg(
        F.count_if(no_record | differs("stage", F.col(run))).alias("summary_stage"),
        F.count_if(no_record | differs("eval_sha256", F.lit(evaluation_hash))).alias("summary_evaluation"),
        F.count_if(no_side | differs("passed", F.col("__p"))).alias("passed"),
        F.count_if(no_side | differs("total", F.col("__t"))).alias("total"),
        F.count_if(no_side | differs("pass_at_1", F.try_divide("__p", "__t"))).alias("pass_at_1"),
    )
    both = config.join(summary, run)
    return both.unpivot([run], [x for x in both.columns if x != run], "check", "violations")


def comparison_violations(runs: DataFrame, run: str, required: list[str]) -> DataFrame:
    """(run, rows) of stages that a comparison has more than once or, with 0 rows, lacks. runs: one row per run compared."""
    have = runs.groupBy(run).agg(F.count("*").alias("rows"))
    must = runs.sparkSession.createDataFrame([(r,) for r in required], f"{run} string").withColumn("__must", F.lit(True))
    every = have.join(must, run, "full_outer").select(run, F.coalesce("rows", F.lit(0)).alias("rows"), "__must")
    return every.where((F.col("rows") > 1) | (F.col("__must") & (F.col("rows") == 0))).drop("__must")


def differing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(check, values): columns that should have one value over all rows and their number of distinct values, null included."""
    counts = df.agg(*(F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in columns))
    return counts.unpivot([], columns, "check", "values")


def dev_metrics(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by..., passed, total, pass_rate, mean_score): a score of 1 passes."""
    return scores.groupBy(*by).agg(F.count_if(F.col(score) == 1.0).alias("passed"), F.count("*").alias("total"), (F.count_if(F.col(score) == 1.0) / F.count("*")).alias("pass_rate"), F.avg(score).alias("mean_score"))
