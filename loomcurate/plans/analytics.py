"""Queries over evaluation runs, audits and training mathematics. Verdicts, scores and rewards are worked out from ids and lengths
by the same formula on both sides; they stand in for the output of a judge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import training as M
from ..operators import audit as A
from ..operators import evaluate as E
from ..operators import sampling as P
from .registry import Tables, query

STAGES = ["base", "full_sft", "lora_sft", "dpo", "ppo", "grpo"]
SUITES = ["stepwise", "longform"]
# One attempt per stage and task: the sample with the least id; base passes unless its id divides by 3, plus unless by 4.
ATTEMPTS = """WITH a AS (SELECT s.stage, e.suite, s.task_id, s.sample_id, CASE WHEN s.sample_id % 3 = 0 THEN 'fail' ELSE 'pass' END AS base_status, CASE WHEN s.sample_id % 4 = 0 THEN 'fail' ELSE 'pass' END AS plus_status
FROM (SELECT stage, task_id, min(sample_id) AS sample_id FROM samples GROUP BY 1, 2) s JOIN evaluation e USING (task_id)),
p AS (SELECT *, base_status = 'pass' AND plus_status = 'pass' AS ok FROM a)"""


def attempts(t: Tables) -> DataFrame:
    first = t.samples.groupBy("stage", "task_id").agg(F.min("sample_id").alias("sample_id"))
    status = lambda n: F.when(F.col("sample_id") % n == 0, "fail").otherwise("pass")
    return first.join(t.evaluation.select("task_id", "suite"), "task_id").select("stage", "suite", "task_id", "sample_id", status(3).alias("base_status"), status(4).alias("plus_status"))


def stage(t: Tables, name: str) -> DataFrame:
    return attempts(t).where(F.col("stage") == name)


@query("s1_4_judge_documents", ATTEMPTS + " SELECT stage, task_id, 0 AS attempt, base_status, plus_status FROM a")
def judge_documents(t):
    one = F.struct("task_id", F.lit(None).cast("string").alias("solution"), "base_status", "plus_status")
    text = attempts(t).select("stage", F.to_json(F.struct(F.create_map("task_id", F.array(one)).alias("eval"))).alias("j"))
    from ..sources.tables import ATTEMPTS as schema

    parsed = text.select("stage", F.from_json("j", schema).alias("d")).select("stage", "d.eval")
    each = parsed.select("stage", F.explode("eval").alias("task_id", "attempts"))
    return each.select("stage", "task_id", F.posexplode("attempts").alias("attempt", "r")).select("stage", "task_id", "attempt", "r.base_status", "r.plus_status")


@query("s6_2_pass_at_1", ATTEMPTS + " SELECT stage, suite, count(*) FILTER (ok) AS passed, count(*) FILTER (base_status = 'pass') AS base_passed, count(*) AS total, round(count(*) FILTER (ok) / count(*), 6) AS pass_at_1 FROM p GROUP BY 1, 2")
def pass_at_1(t):
    return E.pass_at_1(attempts(t), ["stage", "suite"]).withColumn("pass_at_1", F.round("pass_at_1", 6))


@query(
    "s6_4_stage_table",
    ATTEMPTS + f""" SELECT stage, list_position({STAGES!r}, stage) AS position, round(count(*) FILTER (ok AND suite = 'stepwise') / count(*) FILTER (suite = 'stepwise'), 6) AS stepwise,
round(count(*) FILTER (ok AND suite = 'longform') / count(*) FILTER (suite = 'longform'), 6) AS longform FROM p GROUP BY 1""",
)
def stage_table(t):
    wide = E.by_stage(E.pass_at_1(attempts(t), ["stage", "suite"]), STAGES, SUITES)
    return wide.select("stage", "position", *(F.round(s, 6).alias(s) for s in SUITES))


def _pairs(a: str, b: str) -> str:
    return ATTEMPTS + f", j AS (SELECT x.suite, x.task_id, x.ok AS b, y.ok AS c, CASE WHEN x.ok AND NOT y.ok THEN 'lost' WHEN y.ok AND NOT x.ok THEN 'gained' WHEN x.ok THEN 'both_pass' ELSE 'both_fail' END AS transition FROM p x JOIN p y USING (task_id) WHERE x.stage = '{a}' AND y.stage = '{b}')"


@query("s3_10_paired_runs", _pairs("lora_sft", "dpo") + " SELECT suite, task_id, b AS before, c AS after, transition FROM j")
def paired_runs(t):
    return E.paired(stage(t, "lora_sft"), stage(t, "dpo"), ["suite", "task_id"])


@query("s6_5_transitions", _pairs("lora_sft", "dpo") + " SELECT suite, " + ", ".join(f"count(*) FILTER (transition = '{x}') AS {x}" for x in E.TRANSITIONS) + " FROM j GROUP BY 1")
def transitions(t):
    return E.transition_counts(paired_runs(t))


@query("s6_14_any_two_runs", _pairs("base", "grpo") + " SELECT suite, " + ", ".join(f"count(*) FILTER (transition = '{x}') AS {x}" for x in E.TRANSITIONS) + " FROM j GROUP BY 1")
def any_two_runs(t):
    return E.transition_counts(E.paired(stage(t, "base"), stage(t, "grpo"), ["suite", "task_id"]))


@query("s8_1_case_order", _pairs("lora_sft", "dpo") + " SELECT task_id, transition, row_number() OVER (ORDER BY (transition <> 'lost')::int, suite, try_cast(split_part(task_id, '/', 2) AS int), task_id) AS position FROM j")
def case_order(t):
    """Cases of both suites in one order; there are as many as evaluation tasks, a fixed number."""
    from pyspark.sql import Window

    order = E.case_order(F.col("transition"), F.col("suite"), F.col("task_id"))
    return paired_runs(t).select("task_id", "transition", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("position"))


@query("s8_2_stage_order", f"SELECT DISTINCT stage, coalesce(list_position({STAGES!r}, stage), 0) AS position FROM samples")
def stage_order(t):
    return t.samples.select("stage", E.stage_position(F.col("stage"), STAGES).alias("position")).distinct()


@query("s13_1_passed", ATTEMPTS + " SELECT stage, task_id, ok AS passed FROM p")
def passed(t):
    return attempts(t).select("stage", "task_id", E.passed(F.col("base_status"), F.col("plus_status")).alias("passed"))


@query(
    "s13_3_run_checks",
    """WITH h AS (SELECT stage, task_id, count(*) AS n, list_sort(list(coalesce(solution, chr(0)))) IS DISTINCT FROM list_sort(list(CASE WHEN sample_id % 7 = 0 THEN 'changed' ELSE coalesce(solution, chr(0)) END)) AS other FROM samples WHERE task_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT DISTINCT stage FROM samples WHERE task_id IS NOT NULL UNION SELECT 'reference'), x AS (SELECT r.stage, e.task_id FROM r, evaluation e),
f AS (SELECT coalesce(x.stage, h.stage) AS stage, x.task_id IS NULL AS unknown, h.n, coalesce(h.other, false) AS other FROM x FULL JOIN h ON x.stage = h.stage AND x.task_id = h.task_id)
SELECT stage, 'missing_sample' AS "check", count(*) FILTER (n IS NULL) AS violations FROM f GROUP BY 1 UNION ALL SELECT stage, 'missing_verdict', count(*) FILTER (n IS NULL) FROM f GROUP BY 1
UNION ALL SELECT stage, 'unknown_task', count(*) FILTER (unknown) FROM f GROUP BY 1 UNION ALL SELECT stage, 'several_attempts', count(*) FILTER (n > 1) FROM f GROUP BY 1 UNION ALL SELECT stage, 'other_solution', count(*) FILTER (other) FROM f GROUP BY 1""",
)
def run_checks(t):
    """Verdicts on the samples, one in seven of which judged another solution; a stage without samples misses every task."""
    samples = t.samples.where("task_id is not null")
    judged = samples.select("stage", "task_id", F.when(F.col("sample_id") % 7 == 0, "changed").otherwise(F.col("solution")).alias("solution"))
    return E.run_checks(samples, judged, t.evaluation, "stage", [*STAGES, "reference"])


@query(
    "s13_3b_record_checks",
    ATTEMPTS
    + """, c AS (SELECT stage, suite, count(*) FILTER (ok) AS p, count(*) AS t FROM p GROUP BY 1, 2), r AS (SELECT stage, count(*) AS suites, count(*) FILTER (p > 0) AS some FROM c GROUP BY 1)
SELECT stage, 'config_stage' AS "check", (stage = 'ppo')::int AS violations FROM r UNION ALL SELECT stage, 'config_evaluation', (stage = 'dpo')::int FROM r UNION ALL SELECT stage, 'limited', (stage = 'base')::int FROM r
UNION ALL SELECT stage, 'decoding', (stage = 'grpo')::int FROM r UNION ALL SELECT stage, 'summary_stage', 0 FROM r UNION ALL SELECT stage, 'summary_evaluation', 0 FROM r
UNION ALL SELECT stage, 'passed', CASE WHEN stage = 'lora_sft' THEN suites ELSE 0 END FROM r UNION ALL SELECT stage, 'total', 0 FROM r UNION ALL SELECT stage, 'pass_at_1', 0 FROM r""",
)
def record_checks(t):
    """Records of the stages, each with one fault of another kind."""
    counts = E.pass_at_1(attempts(t), ["stage", "suite"])
    stage, others = F.col("stage"), lambda s, bad, good: F.when(F.col("stage") == s, bad).otherwise(good)
    configs = counts.select("stage").distinct().select(
        others("ppo", F.lit("ppo2"), stage).alias("stage_said"), stage, others("dpo", F.lit("old"), F.lit("now")).alias("eval_sha256"), others("base", F.lit(10), F.lit(None)).alias("limit_per_suite"),
        F.lit(False).alias("do_sample"), others("grpo", F.lit(1024), F.lit(512)).alias("max_new_tokens"),
    )
    configs = configs.withColumn("run", stage).drop("stage").withColumnRenamed("stage_said", "stage")
    summaries = counts.select(stage.alias("run"), "stage", "suite", F.lit("now").alias("eval_sha256"), others("lora_sft", F.col("passed") + 1, F.col("passed")).alias("passed"), "total", "pass_at_1")
    return E.record_checks(configs, summaries, counts.select(stage.alias("run"), "suite", "passed", "total"), "now", "run").withColumnRenamed("run", "stage")


@query("s13_5_single_stage", "SELECT stage, count(*) + (stage = 'dpo')::int AS rows FROM (SELECT DISTINCT stage FROM samples) GROUP BY 1 HAVING count(*) + (stage = 'dpo')::int > 1 UNION ALL SELECT 'reference', 0")
def single_stage(t):
    """A comparison that takes one stage twice and lacks another."""
    runs = t.samples.select("stage").distinct()
    return E.comparison_violations(runs.unionByName(runs.where("stage = 'dpo'")), "stage", [*STAGES, "reference"])


@query("s13_4_environment", "SELECT 'suite' AS \"check\", count(DISTINCT suite) AS values FROM evaluation UNION ALL SELECT 'entry_point', count(DISTINCT entry_point) FROM evaluation")
def environment(t):
    return E.differing(t.evaluation, ["suite", "entry_point"])


# ---- audits


@query("s6_6_histogram", "SELECT len(tests) AS value, count(*) AS rows FROM grpo WHERE tests IS NOT NULL GROUP BY 1")
def histogram(t):
    return A.distribution(t.grpo.where("tests is not null"), F.size("tests"))


@query("s6_7_duplicates", "SELECT count(prompt) - count(DISTINCT prompt) AS duplicate_prompt, count(source_id) - count(DISTINCT source_id) AS duplicate_source_id FROM sft")
def duplicates(t):
    return A.duplicate_count(t.sft, ["prompt", "source_id"])


@query("s6_8_split_overlap", "SELECT count(*) AS overlap FROM (SELECT prompt FROM sft WHERE split = 'train' AND prompt IS NOT NULL INTERSECT SELECT prompt FROM sft WHERE split = 'valid')")
def split_overlap(t):
    return A.split_overlap(t.sft, "split", "prompt", "train", "valid")


@query("s6_9_tallies", "SELECT count(*) FILTER (regexp_matches(prompt, '\\b' || entry_point || '\\b')) AS mentioned, count(*) FILTER (starts_with(prompt, 'def')) AS with_header FROM evaluation")
def tallies(t):
    return t.evaluation.agg(F.count_if(X.mentions(F.col("prompt"), F.col("entry_point"))).alias("mentioned"), F.count_if(F.col("prompt").startswith("def")).alias("with_header"))


AUDIT = """WITH a AS (SELECT row_id, split, row_id % 9 > 0 AS reference_ok, row_id % 11 = 0 AS constant_passes, row_id % 6 > 0 AS calls, list_transform(range(row_id % 4), lambda i: CASE WHEN (row_id + i) % 3 = 0 THEN 0.5 ELSE 1.0 END) AS mutants FROM grpo),
r AS (SELECT *, list_filter([CASE WHEN NOT reference_ok THEN 'reference_or_example_failed' END, CASE WHEN constant_passes THEN 'constant_output_passes_all' END, CASE WHEN NOT calls THEN 'assertion_does_not_call_function' END,
CASE WHEN len(mutants) >= 2 AND len(list_filter(mutants, lambda x: x < 1)) = 0 THEN 'all_checked_mutants_survive' END], lambda x: x IS NOT NULL) AS reasons FROM a)"""


def audited(t: Tables) -> DataFrame:
    i = F.col("row_id")
    n = (i % 4).cast("int")
    mutants = F.transform(F.slice(F.array(*(F.lit(k) for k in range(4))), 1, n), lambda k: F.when((i + k) % 3 == 0, 0.5).otherwise(1.0))
    rows = t.grpo.select("row_id", "split", "source_id", mutants.alias("mutants"))
    reference, constant = F.when(i % 9 > 0, 1.0).otherwise(0.5), F.when(i % 11 == 0, 1.0).otherwise(0.0)
    return rows.withColumn("reasons", A.quality_reasons(reference, constant, i % 6 > 0, F.col("mutants")))


@query("s6_10_audit_counts", AUDIT + " SELECT split, count(*) AS checked, count(*) FILTER (len(reasons) = 0) AS accepted, sum(len(mutants)) AS mutants_executed, sum(len(list_filter(mutants, lambda x: x < 1))) AS mutants_failed, count(*) FILTER (len(mutants) = 0) AS without_mutation FROM r GROUP BY 1")
def audit_counts(t):
    return A.audit_counts(audited(t), "split")


@query("s11_6_quality_reasons", AUDIT + " SELECT split, reason, count(*) AS rows FROM (SELECT split, unnest(CASE WHEN len(reasons) = 0 THEN [NULL] ELSE reasons END) AS reason FROM r) GROUP BY 1, 2")
def quality_reasons(t):
    return A.reason_counts(audited(t), ["split"])


@query("s11_5_execution_accepts", "SELECT row_id, row_id % 5 > 0 AND row_id % 7 > 0 AND (row_id % 2 = 0 OR row_id % 3 > 0) AS ok FROM grpo")
def execution_accepts(t):
    i = F.col("row_id")
    one = lambda c, other: F.when(c, 1.0).otherwise(other)
    return t.grpo.select("row_id", A.execution_accepts(one(i % 5 > 0, 0.9), one(i % 7 == 0, 0.2), F.when(i % 2 == 1, one(i % 3 > 0, 0.0))).alias("ok"))


@query("s11_1_scored", "SELECT row_id, CASE WHEN tests IS NULL OR len(tests) = 0 THEN 0.0 ELSE (len(tests) - 1) / len(tests) END AS score FROM grpo WHERE prompt IS NOT NULL")
def scored(t):
    def all_but_one(codes: list[str], tests: list[list[str]]) -> list[float]:
        return [(len(x) - 1) / len(x) if x else 0.0 for x in tests]

    return A.score_with(t.grpo.where("prompt is not null").select("row_id", "prompt", "tests"), all_but_one, "prompt", "tests").select("row_id", "score")


@query("s11_3_checked_scores", "SELECT row_id, (row_id % 11) / 10.0 AS score FROM grpo")
def checked_scores(t):
    return t.grpo.select("row_id", A.checked_score((F.col("row_id") % 11) / 10.0).alias("score"))


@query("s11_7_example_exclusions", "SELECT source_id, bool_or(length(prompt) % 5 = 0) IS TRUE AS excluded FROM rl GROUP BY 1")
def example_exclusions(t):
    return A.excluding(t.rl, "source_id", F.length("prompt") % 5 == 0)


@query(
    "s11_8_rescored",
    """SELECT row_id, (row_id % 3) / 2.0 AS stated, score, coalesce((row_id % 3) / 2.0 = score, false) AS matched
FROM (SELECT row_id, CASE WHEN tests IS NULL OR len(tests) = 0 THEN 0.0 ELSE (len(tests) % 3) / 2.0 END AS score FROM grpo ORDER BY sha256('20261004|' || row_id), row_id LIMIT 20)""",
)
def rescored(t):
    """A seeded sample scored again, beside the scores stated before."""

    def scorer(codes: list[str], tests: list[list[str]]) -> list[float]:
        return [len(x) % 3 / 2 for x in tests]

    rows = t.grpo.select("row_id", F.coalesce("prompt", F.lit("")).alias("prompt"), "tests", ((F.col("row_id") % 3) / 2).alias("stated"))
    return A.reexecuted(rows, "row_id", 20261004, 20, scorer, "prompt", "tests", "stated")


@query("s11_4_regrouped", "SELECT row_id, list_transform(tests, lambda x: length(x)) AS lengths FROM grpo WHERE len(tests) > 0")
def regrouped(t):
    """Scores of single tests back in the batches they came from."""
    flat = A.flattened(t.grpo, "row_id", "tests").withColumn("n", F.length("test"))
    return A.regrouped(flat, "row_id", "n").withColumnRenamed("values", "lengths")


@query("s6_11_spread", "SELECT split, min(completion_tokens) AS least, round(median(completion_tokens), 6) AS median, max(completion_tokens) AS greatest FROM sft WHERE completion_tokens IS NOT NULL GROUP BY 1")
def spread(t):
    return A.spread(t.sft.where("completion_tokens is not null"), ["split"], "completion_tokens").withColumn("median", F.round("median", 6))


# ---- rollouts: samples of a task in groups of four by id, rewarded by their length

ROLLOUTS = """WITH o AS (SELECT DISTINCT stage, task_id, sample_id FROM samples WHERE task_id IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY stage, task_id ORDER BY sample_id) - 1 AS i FROM o),
g AS (SELECT stage, task_id || ':' || (i // 4) AS grp, sample_id, (sample_id % 5) / 4.0 AS reward FROM n),
f AS (SELECT * FROM g WHERE grp || stage IN (SELECT grp || stage FROM g GROUP BY grp, stage HAVING count(*) = 4))"""


def rollouts(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    once = t.samples.where("task_id is not null").select("stage", "task_id", "sample_id").distinct()
    n = F.row_number().over(Window.partitionBy("stage", "task_id").orderBy("sample_id")) - 1
    g = once.select("stage", F.concat("task_id", F.lit(":"), F.floor(n / 4).cast("string")).alias("grp"), "sample_id", ((F.col("sample_id") % 5) / 4.0).alias("reward"))
    return g.withColumn("n", F.count("*").over(Window.partitionBy("stage", "grp"))).where("n = 4").drop("n")


@query("s7_2_group_advantages", ROLLOUTS + " SELECT stage, sample_id, round(CASE WHEN stddev_pop(reward) OVER w <= 1e-8 THEN 0 ELSE (reward - avg(reward) OVER w) / stddev_pop(reward) OVER w END, 6) + 0.0 AS advantage FROM f WINDOW w AS (PARTITION BY stage, grp)")
def group_advantages(t):
    rows = rollouts(t).withColumn("key", F.struct("stage", "grp"))
    return M.group_advantages(rows, "key", "reward").select("stage", "sample_id", (F.round("advantage", 6) + 0.0).alias("advantage"))


@query("s6_12_dev_metrics", ROLLOUTS + " SELECT stage, count(*) FILTER (reward = 1) AS passed, count(*) AS total, round(count(*) FILTER (reward = 1) / count(*), 6) AS pass_rate, round(avg(reward), 6) AS mean_score FROM f GROUP BY 1")
def dev_metrics(t):
    return E.dev_metrics(rollouts(t), ["stage"], "reward").withColumn("pass_rate", F.round("pass_rate", 6)).withColumn("mean_score", F.round("mean_score", 6))


@query("s6_13_tallies", ROLLOUTS + ", d AS (SELECT stage, grp, max(reward) - min(reward) AS r, count(*) FILTER (sample_id % 3 = 0) AS t FROM f GROUP BY 1, 2) SELECT stage, count(*) AS groups, count(*) FILTER (r = 0) AS zero_variance, count(*) FILTER (r > 0) AS effective, sum(t) AS truncated FROM d GROUP BY 1")
def rollout_tallies(t):
    return A.rollout_tallies(rollouts(t), "stage", "grp", "reward", F.col("sample_id") % 3 == 0)


@query("s6_13_running", ROLLOUTS + ", d AS (SELECT stage, grp, max(reward) - min(reward) AS r FROM f GROUP BY 1, 2) SELECT stage, grp, count(*) FILTER (r = 0) OVER w AS zero_variance_so_far, count(*) FILTER (r > 0) OVER w AS effective_so_far FROM d WINDOW w AS (PARTITION BY stage ORDER BY grp ROWS UNBOUNDED PRECEDING)")
def running(t):
    return A.running_tallies(rollouts(t), "stage", "grp", "reward")


@query("s7_6_best_so_far", "SELECT event_id, max(value) OVER w AS best, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def best_so_far(t):
    return A.best_so_far(t.events.select("event_id", "user_id", "value"), "event_id", "value", "user_id").select("event_id", "best", "improved")


@query("s4_12_best_checkpoint", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def best_checkpoint(t):
    return A.checkpoint_of_best(t.events, "user_id", "event_id", "value")


@query("s4_12b_least_loss", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events) WHERE n = 1")
def least_loss(t):
    return A.checkpoint_of_least(t.events, "user_id", "event_id", "value")


# ---- mathematics over arrays: halves of an embedding stand for old and new log-probabilities


def vectors(t: Tables) -> DataFrame:
    d = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return d.select("vec_id", F.slice("e", 1, 16).alias("a"), F.slice("e", 17, 16).alias("b"), F.slice("e", 33, 16).alias("c"), F.slice("e", 49, 16).alias("d"), "e")


V = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), h AS (SELECT vec_id, e, e[1:16] AS a, e[17:32] AS b, e[33:48] AS c, e[49:64] AS d FROM v)"


def _r(c: F.Column, places: int = 5) -> F.Column:
    return F.round(c, places) + 0.0


@query(
    "s7_3_gae",
    """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), h AS (SELECT vec_id, e[1:16] AS a, e[17:32] AS b FROM v),
g AS (SELECT vec_id, 16 AS i, a[16] - b[16] AS adv, a[16] - b[16] AS total FROM h UNION ALL SELECT g.vec_id, i - 1, a[i - 1] + b[i] - b[i - 1] + 0.95 * adv, total + a[i - 1] + b[i] - b[i - 1] + 0.95 * adv FROM g JOIN h USING (vec_id) WHERE i > 1)
SELECT vec_id, round(adv, 5) + 0.0 AS first, round(total, 5) + 0.0 AS total FROM g WHERE i = 1""",
)
def gae(t):
    g = vectors(t).select("vec_id", M.gae(F.col("a"), F.col("b"))["advantages"].alias("g"))
    return g.select("vec_id", _r(F.col("g")[0]).alias("first"), _r(M.total(F.col("g"))).alias("total"))


@query("s7_4_whiten", V + " SELECT vec_id, round((a[1] - list_avg(a)) / (list_stddev_pop(a) + 1e-8), 5) + 0.0 AS first FROM h")
def whiten(t):
    return vectors(t).select("vec_id", _r(M.whiten(F.col("a"))[0]).alias("first"))


@query("s7_5_shaped_rewards", V + " SELECT vec_id, round(-0.02 * (a[1] - b[1]), 6) + 0.0 AS first, round(-0.02 * (a[16] - b[16]) + greatest(-5, least(5, 10 * c[1])), 6) + 0.0 AS last FROM h")
def shaped_rewards(t):
    s = M.shaped_rewards(F.col("a"), F.col("b"), F.col("c")[0] * 100)
    return vectors(t).select("vec_id", _r(s[0], 6).alias("first"), _r(s[15], 6).alias("last"))


@query("s12_1_action_logprobs", V + " SELECT vec_id, round(c[4] / 0.8 - ln(list_sum(list_transform(c, lambda x: exp(x / 0.8)))), 5) + 0.0 AS first FROM h")
def action_logprobs(t):
    logits, tokens = F.array("a", "b", "c", "d"), F.array(*(F.lit(i) for i in (0, 1, 2, 3)))
    lp = M.action_logprobs(logits, tokens, F.lit(3), 0.8)
    return vectors(t).select("vec_id", _r(lp[0]).alias("first"))


@query("s12_2_sequence_logprob", V + " SELECT vec_id, round(list_sum(a), 5) + 0.0 AS logprob FROM h")
def sequence_logprob(t):
    return vectors(t).select("vec_id", _r(M.total(F.col("a"))).alias("logprob"))


@query("s12_3_dpo_loss", V + ", z AS (SELECT vec_id, 0.1 * ((list_sum(a) - list_sum(b)) - (list_sum(c) - list_sum(d))) AS z FROM h) SELECT vec_id, round(ln(1 + exp(-abs(z))) + greatest(-z, 0), 5) + 0.0 AS loss FROM z")
def dpo_loss(t):
    a, b, c, d = (M.total(F.col(x)) for x in "abcd")
    return vectors(t).select("vec_id", _r(M.dpo_loss(a, b, c, d)).alias("loss"))


@query("s12_4_mean_loss", V + ", z AS (SELECT 0.1 * ((list_sum(a) - list_sum(b)) - (list_sum(c) - list_sum(d))) AS z FROM h) SELECT count(*) AS pairs, round(avg(ln(1 + exp(-abs(z))) + greatest(-z, 0)), 5) AS loss FROM z")
def mean_loss(t):
    a, b, c, d = (M.total(F.col(x)) for x in "abcd")
    return vectors(t).select(M.dpo_loss(a, b, c, d).alias("l")).agg(F.count("*").alias("pairs"), F.round(F.avg("l"), 5).alias("loss"))


RATIO = "list_transform(range(1, 17), lambda i: exp(greatest(-20, least(20, a[i] - b[i]))))"


@query("s12_5_grpo_loss", V + f", r AS (SELECT vec_id, c[1] AS w, {RATIO} AS r FROM h) SELECT vec_id, round(list_avg(list_transform(r, lambda x: -least(x * w, greatest(0.8, least(1.2, x)) * w))), 5) + 0.0 AS loss FROM r")
def grpo_loss(t):
    return vectors(t).select("vec_id", _r(M.grpo_loss(F.col("a"), F.col("b"), F.col("c")[0])).alias("loss"))


@query("s12_6_clip_fraction", V + f", r AS (SELECT vec_id, {RATIO} AS r FROM h) SELECT vec_id, round(len(list_filter(r, lambda x: abs(x - 1) > 0.2)) / 16.0, 5) AS fraction FROM r")
def clip_fraction(t):
    return vectors(t).select("vec_id", F.round(M.clip_fraction(F.col("a"), F.col("b")), 5).alias("fraction"))


@query(
    "s12_7_ppo_loss",
    V + f""", r AS (SELECT vec_id, {RATIO} AS r, a, b, c, d FROM h),
l AS (SELECT vec_id, list_avg(list_transform(range(1, 17), lambda i: -least(r[i] * d[i], greatest(0.8, least(1.2, r[i])) * d[i]))) AS p,
0.5 * list_avg(list_transform(range(1, 17), lambda i: greatest((c[i] - a[i]) ** 2, (b[i] + greatest(-0.2, least(0.2, c[i] - b[i])) - a[i]) ** 2))) AS v FROM r)
SELECT vec_id, round(p, 5) + 0.0 AS policy, round(v, 5) + 0.0 AS value, round(p + 0.5 * v, 5) + 0.0 AS total FROM l""",
)
def ppo_loss(t):
    l = M.ppo_loss(F.col("a"), F.col("b"), F.col("c"), F.col("b"), F.col("d"), F.col("a"))
    return vectors(t).select("vec_id", l.alias("l")).select("vec_id", *(_r(F.col(f"l.{x}")).alias(x) for x in ("policy", "value", "total")))


@query("s12_8_length_limit", "SELECT vec_id, len(embedding) = 64 AND label <> 3 AS hit FROM embeddings")
def length_limit(t):
    tokens = F.concat(F.array_repeat(F.lit(0), 63), F.array("label"))
    return t.embeddings.select("vec_id", M.hit_length_limit(tokens, 64, 3).alias("hit"))


@query("s12_9_pair_loss", V + " SELECT vec_id, round(ln(1 + exp(-abs(a[1] - b[1]))) + greatest(b[1] - a[1], 0), 5) + 0.0 AS loss FROM h")
def pair_loss(t):
    return vectors(t).select("vec_id", _r(M.pair_loss(F.col("a")[0], F.col("b")[0])).alias("loss"))


@query("s12_11_batches", "SELECT row_id, (row_number() OVER (PARTITION BY split ORDER BY row_id) - 1) // 16 AS batch FROM rl")
def batches(t):
    return P.batches(t.rl.select("row_id", "split"), "row_id", "split", 16).select("row_id", "batch")


@query("s6_15_integrity", "SELECT 'rl' AS name, count(*) AS rows, count(tests) AS locked_rows, (count(*) <> count(tests))::int AS violations FROM rl UNION ALL SELECT 'grpo', count(*), count(*), 0 FROM grpo")
def integrity(t):
    """Tables against the lock of a version in which rl lacked the rows without tests."""
    from ..sources.tables import integrity as check
    from ..sources.tables import lock_of

    return check({"rl": t.rl, "grpo": t.grpo}, lock_of({"rl": t.rl.where("tests is not null"), "grpo": t.grpo}))


@query("s12_12_cross_check", V + ", z AS (SELECT vec_id, 0.1 * ((list_sum(a) - list_sum(b)) - (list_sum(c) - list_sum(d))) AS z FROM h) SELECT vec_id, round(ln(1 + exp(-abs(z))) + greatest(-z, 0), 5) + 0.0 AS loss, true AS agrees FROM z")
def cross_check(t):
    """The preference loss beside an independent one in numpy."""

    @F.pandas_udf("double")
    def other(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        margin = np.stack(a).sum(1) - np.stack(c).sum(1) - (np.stack(b).sum(1) - np.stack(d).sum(1))
        return pd.Series(np.logaddexp(0, -0.1 * margin))

    a, b, c, d = (M.total(F.col(x)) for x in "abcd")
    both = vectors(t).select("vec_id", M.dpo_loss(a, b, c, d).alias("l"), other("a", "b", "c", "d").alias("o"))
    return both.select("vec_id", _r(F.col("l")).alias("loss"), (F.abs(F.col("l") - F.col("o")) <= 1e-7).alias("agrees"))


# ---- reports and checks of a whole repository


@query("s1_16_markdown", "SELECT * FROM (SELECT '| value | rows |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || len(tests) || ' | ' || count(*) || ' |' FROM grpo WHERE tests IS NOT NULL GROUP BY len(tests))")
def markdown(t):
    """The lines of a Markdown report."""
    from ..sources.reports import markdown_table

    return t.spark.createDataFrame([(x,) for x in markdown_table(histogram(t)).splitlines()], "line string")


@query("s1_15_html", _pairs("lora_sft", "dpo") + " SELECT transition, count(*) AS cases FROM j WHERE transition IN ('lost', 'gained') GROUP BY 1")
def html_report(t):
    """The cases of an HTML page, counted in the page itself."""
    import re
    from collections import Counter

    from ..sources.reports import case_report

    cases = paired_runs(t).where("transition in ('lost', 'gained')").select("task_id", "transition", F.lit("<a>").alias("before"), F.lit("<b>").alias("after"))
    kinds = Counter(re.findall(r'<section data-kind="(\w+)"', case_report(cases, "cases")))
    return t.spark.createDataFrame(sorted(kinds.items()), "transition string, cases long")


@query(
    "s13_7_bindings",
    """WITH s AS (SELECT 'audit' AS name, 'grpo' AS key, count(*) AS stated, count(*) AS found FROM grpo UNION ALL SELECT 'audit', 'scorer', 1, 2 UNION ALL SELECT 'review', 'grpo', count(tests), count(*) FROM grpo UNION ALL SELECT 'review', 'script', 1, NULL)
SELECT name, key, stated::varchar AS stated, found::varchar AS found FROM s WHERE stated IS DISTINCT FROM found""",
)
def bindings(t):
    """Records bound to sources, scorers and scripts: the scorer has changed, the review is of another version, the script is gone."""
    from ..sources.tables import binding_violations

    n = lambda c, name, key: t.grpo.agg(c.cast("string").alias("value")).select(F.lit(name).alias("name"), F.lit(key).alias("key"), "value")
    fixed = lambda *rows: t.spark.createDataFrame(list(rows), "name string, key string, value string")
    stated = n(F.count("*"), "audit", "grpo").unionByName(n(F.count("tests"), "review", "grpo")).unionByName(fixed(("audit", "scorer", "1"), ("review", "script", "1")))
    found = n(F.count("*"), "now", "grpo").unionByName(fixed(("now", "scorer", "2"), ("now", "unbound", "3")))
    return binding_violations(stated, found)


@query(
    "s13_6_repository",
    """SELECT 'data' AS part, 'rl' AS name, 'fingerprint' AS "check", 1 AS violations FROM rl HAVING count(*) <> count(tests) UNION ALL SELECT 'data', 'rl', 'rows', 1 FROM rl HAVING count(*) <> count(tests)
UNION ALL SELECT 'data', 'gone', 'missing', 1 UNION ALL SELECT 'results', stage, 'unknown_task', count(DISTINCT task_id) FROM samples WHERE task_id NOT IN (SELECT task_id FROM evaluation WHERE task_id IS NOT NULL) GROUP BY stage
UNION ALL SELECT 'documents', 'docs/' || doc_id || '.md', 'link', 3 FROM documents WHERE doc_id % 3 = 0""",
)
def repository(t):
    """Data, results and documents in one report; every third document has three links to files that aren't there."""
    from ..sources.tables import fingerprint, lock_of, repository_checks

    hash_of = fingerprint(t.evaluation).first()["fingerprint"]
    lock = lock_of({"rl": t.rl.where("tests is not null"), "grpo": t.grpo}, evaluation=hash_of)
    lock["tables"]["gone"] = {"rows": 1, "fingerprint": ""}
    samples = t.samples.where("task_id is not null")
    runs = E.run_checks(samples, samples, t.evaluation, "stage").where("check = 'unknown_task'")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    local = F.concat(F.lit("[a](#x) [b](../README.md#y) [c](./"), F.col("doc_id").cast("string"), F.lit(".md) [d](https://x.example/z) <img src='/README.md'>"))
    broken = F.when(F.col("doc_id") % 3 == 0, F.lit(" [e](gone.md) [f](../../above.md) [g](../docs/gone.md)")).otherwise("")
    pages = t.documents.select(path.alias("path"), F.concat(local, broken).alias("text"))
    files = pages.select("path").unionByName(t.spark.createDataFrame([("README.md",)], "path string"))
    return repository_checks({"rl": t.rl, "grpo": t.grpo}, lock, hash_of, runs, pages, files)
