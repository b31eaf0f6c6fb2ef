"""Training mathematics over arrays of doubles, as Spark columns. Gradients and optimisers are out of scope.

Arrays of one row must have equal lengths; null arrays give null, empty arrays the stated value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Coefficients of the losses.
BETA, CLIP, DELTA_LIMIT = 0.1, 0.2, 20.0
GAMMA, LAMBDA, KL_COST = 1.0, 0.95, 0.02
REWARD_SCALE, REWARD_LIMIT = 10.0, 5.0
GROUP = 4


def total(a: Column) -> Column:
    """Sum of an array; 0 if empty."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Mean of an array; null if empty."""
    return total(a) / F.nullif(F.size(a), F.lit(0))


def pop_std(a: Column) -> Column:
    m = mean(a)
    return F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m))))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def group_advantages(df: DataFrame, group: str, reward: str, expected: int = GROUP) -> DataFrame:
    """Adds `advantage`: reward less the group's mean by its population deviation; 0 where all rewards are (nearly) equal.

    Raises while running if a group hasn't exactly `expected` rewards in [0, 1]; null and NaN count as outside.
    """
    w = Window.partitionBy(group)
    r = F.col(reward)
    valid = (F.count("*").over(w) == expected) & (F.min(F.coalesce(r.between(0, 1) & ~F.isnan(r), F.lit(False)).cast("int")).over(w) == 1)
    fault = F.raise_error(F.lit(f"a group needs {expected} finite rewards from 0 to 1")).cast("double")
    std = F.stddev_pop(r).over(w)
    return df.withColumn("advantage", F.when(~valid, fault).when(std <= 1e-8, 0.0).otherwise((r - F.avg(r).over(w)) / std))


def gae(rewards: Column, values: Column, gamma: float = GAMMA, lam: float = LAMBDA) -> Column:
    """struct<advantages, returns>: generalised advantage estimates, computed backwards; the value after the end is 0."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v")))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = x["r"] + gamma * s["v"] - x["v"] + gamma * lam * s["a"]
        return F.struct(a.alias("a"), x["v"].cast("double").alias("v"), F.array_append(s["out"], a).alias("out"))

    advantages = F.reverse(F.aggregate(pairs, start, step)["out"])
    return F.struct(advantages.alias("advantages"), F.zip_with(advantages, values, lambda a, v: a + v).alias("returns"))


def whiten(a: Column) -> Column:
    """Less the mean, by population deviation plus 1e-8; arrays of one element stay as they are."""
    m, s = mean(a), pop_std(a)
    return F.when(F.size(a) > 1, F.transform(a, lambda x: (x - m) / (s + 1e-8))).otherwise(a)


def shaped_rewards(old: Column, reference: Column, score: Column) -> Column:
    """Per token -KL_COST times the log-ratio; the last one also gets the scaled and clamped score."""
    bonus = clamp(score / REWARD_SCALE, -REWARD_LIMIT, REWARD_LIMIT)
    base = F.zip_with(old, reference, lambda o, r: (o - r) * -KL_COST)
    return F.transform(base, lambda x, i: F.when(i == F.size(old) - 1, x + bonus).otherwise(x))


def log_softmax_at(logits: Column, index: Column, temperature: float = 1.0) -> Column:
    """Log-probability of the element at a 0-based index."""
    z = F.transform(logits, lambda x: x.cast("double") / temperature)
    top = F.array_max(z)
    return F.get(z, index) - top - F.log(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def action_logprobs(logits: Column, tokens: Column, prompt_length: Column, temperature: float = 1.0) -> Column:
    """Log-probabilities of the tokens after the prompt; row i of the logits predicts token i + 1."""
    rows = F.slice(logits, prompt_length, F.size(tokens) - prompt_length)
    actions = F.slice(tokens, prompt_length + 1, F.size(tokens) - prompt_length)
    return F.zip_with(rows, actions, lambda row, token: log_softmax_at(row, token, temperature))


def neg_log_sigmoid(z: Column) -> Column:
    """-log(1 / (1 + exp(-z))), without overflow."""
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))


def dpo_loss(chosen: Column, rejected: Column, reference_chosen: Column, reference_rejected: Column, beta: float = BETA) -> Column:
    return neg_log_sigmoid(beta * ((chosen - rejected) - (reference_chosen - reference_rejected)))


def pair_loss(chosen: Column, rejected: Column) -> Column:
    """Reward-model loss of a pair of scores."""
    return neg_log_sigmoid(chosen - rejected)


def _clipped(new: Column, old: Column, advantage, clip: float) -> Column:
    def one(n: Column, o: Column, a: Column) -> Column:
        ratio = F.exp(clamp(n - o, -DELTA_LIMIT, DELTA_LIMIT))
        return -F.least(ratio * a, clamp(ratio, 1 - clip, 1 + clip) * a)

    return one(new, old, advantage)


def grpo_loss(new: Column, old: Column, advantage: Column, clip: float = CLIP) -> Column:
    """Token mean of the clipped objective with one advantage for the whole answer."""
    return mean(F.zip_with(new, old, lambda n, o: _clipped(n, o, advantage, clip)))


def clip_fraction(new: Column, old: Column, clip: float = CLIP) -> Column:
    """Share of tokens whose unclamped ratio lies outside the clip range; null if empty."""
    return mean(F.zip_with(new, old, lambda n, o: F.when(F.abs(F.exp(n - o) - 1) > clip, 1.0).otherwise(0.0)))


def ppo_loss(new: Column, old: Column, values: Column, old_values: Column, advantages: Column, returns: Column, clip: float = CLIP) -> Column:
    """struct<policy, value, total>: clipped policy loss, half the clipped value loss, and policy + value / 2."""
    at = F.arrays_zip(new.alias("n"), old.alias("o"), advantages.alias("a"), values.alias("v"), old_values.alias("w"), returns.alias("r"))
    policy = mean(F.transform(at, lambda x: _clipped(x["n"], x["o"], x["a"], clip)))

    def squared(x: Column) -> Column:
        near = x["w"] + clamp(x["v"] - x["w"], -clip, clip)
        return F.greatest((x["v"] - x["r"]) * (x["v"] - x["r"]), (near - x["r"]) * (near - x["r"]))

    value = 0.5 * mean(F.transform(at, squared))
    return F.struct(policy.alias("policy"), value.alias("value"), (policy + 0.5 * value).alias("total"))


def hit_length_limit(tokens: Column, limit: int, eos: int) -> Column:
    """Whether an answer has as many tokens as allowed and doesn't end with the end token."""
    return (F.size(tokens) == limit) & (F.element_at(tokens, -1) != eos)
