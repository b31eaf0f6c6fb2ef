"""Problem 4: filling token sequences of one capacity with documents, by a configuration linear program.

Plan. Executors count tokens and cut texts longer than the capacity into full pieces and a rest. The histogram of piece
lengths has at most `capacity` rows, however many documents there are; on it the driver solves the configuration linear
program by multiplicative weights, where a knapsack dynamic program prices the best configuration, rounds the solution down
and fills what is left greedily, configuration by configuration. The result is a table of configurations with their numbers
of sequences, of a size bounded by the capacity. Pieces of one length are interchangeable: each gets its rank among its
length (counted in BUCKETS parts, so that a common length isn't ranked in one task), and the rank gives the sequence.

Null and empty texts have no tokens and get one row without a sequence. A text is cut only if it alone exceeds the capacity.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tokens import default_vocabulary, token_counts

CAPACITY = 2048
#: Rounds of the multiplicative weights and their learning rate.
ROUNDS, RATE = 400, 0.2
#: How fast the price of a length falls with its coverage; the best packing of all is kept.
SHARPNESS = (1.0, 4.0, 16.0)
#: Solutions rounded down leave pieces over, which are solved for again.
PASSES = 4
BUCKETS = 256


@dataclasses.dataclass
class Plan:
    """Runs of equal sequences: ranks first_rank.. of pieces of a length go, `each` at a time, to sequences first_sequence.."""

    length: np.ndarray
    first_rank: np.ndarray
    first_sequence: np.ndarray
    each: np.ndarray
    sequences: int
    lower_bound: float


def best_configuration(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The unbounded knapsack: (value, {index: times}) of the most valuable multiset of lengths within the capacity. lengths ascend."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], taken[c] = best[c - 1], -1
        if fits[c]:
            total = best[c - lengths[: fits[c]]] + values[: fits[c]]
            i = int(total.argmax())
            if total[i] > best[c]:
                best[c], taken[c] = total[i], i
    used: dict[int, int] = {}
    c = capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            used[int(taken[c])] = used.get(int(taken[c]), 0) + 1
            c -= int(lengths[taken[c]])
    return float(best[capacity]), used


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, sharpness: float, rate: float = RATE) -> tuple[list[tuple[dict[int, int], float]], float]:
    """A fractional solution [(configuration, sequences)] of the covering program, and a lower bound on any packing.

    Multiplicative weights: a length's price is its size times exp(-sharpness * coverage). Each round adds the best
    configuration at these prices, as often as it takes to cover one of its lengths by `rate` of its count. Scaled prices are
    dual solutions, which give the bound. The solution is scaled to cover all pieces once on average.
    """
    covered = np.zeros(len(lengths))
    chosen: dict[tuple, float] = {}
    weight = lengths * counts
    bound = float(weight.sum()) / capacity
    for _ in range(rounds):
        prices = lengths / capacity * np.exp(-sharpness * (covered - covered.min()))
        value, used = best_configuration(lengths, prices, capacity)
        bound = max(bound, float((prices * counts).sum()) / value)
        index, times = np.array(list(used)), np.array(list(used.values()))
        step = float((counts[index] / times).min()) * rate
        covered[index] += times * step / counts[index]
        key = tuple(sorted(used.items()))
        chosen[key] = chosen.get(key, 0.0) + step
    scale = 1 / max(1e-9, float((covered * weight).sum() / weight.sum()))
    return [(dict(k), x * scale) for k, x in chosen.items()], bound


def _greedy(lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """One sequence filled from the longest pieces downwards."""
    used: dict[int, int] = {}
    room = capacity
    i = len(lengths) - 1
    while i >= 0 and room >= lengths[0]:
        i = min(i, int(np.searchsorted(lengths, room, "right")) - 1)
        while i >= 0 and left[i] == 0:
            i -= 1
        if i < 0:
            break
        n = int(min(left[i], room // lengths[i]))
        used[i] = n
        room -= n * int(lengths[i])
        i -= 1
    return used


def _packed(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, sharpness: float) -> Plan:
    rows: list[tuple[int, int, int, int]] = []
    left, sequences, bound = counts.copy(), 0, 0.0

    def use(config: dict[int, int], times: int) -> None:
        nonlocal sequences
        for i, n in config.items():
            rows.append((int(lengths[i]), int(counts[i] - left[i]), sequences, n))
            left[i] -= n * times
        sequences += times

    for number in range(PASSES):
        here = np.flatnonzero(left)
        if not len(here):
            break
        solution, least = configurations(lengths[here], left[here].astype(float), capacity, rounds // PASSES, sharpness)
        bound = least if number == 0 else bound
        for config, x in sorted(solution, key=lambda s: -s[1]):
            config = {int(here[i]): n for i, n in config.items()}
            if times := int(min(np.floor(x), min(left[i] // n for i, n in config.items()))):
                use(config, times)
    while left.any():
        config = _greedy(lengths, left, capacity)
        use(config, int(min(left[i] // n for i, n in config.items())))
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequences, bound)


def pack_histogram(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Plan:
    """Packs counts of lengths (1..capacity) into sequences; an empty histogram gives an empty plan."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    counts = np.array([histogram[int(k)] for k in lengths], np.int64)
    best: Plan | None = None
    for sharpness in SHARPNESS:
        plan = _packed(lengths, counts, capacity, rounds, sharpness)
        bound = max(plan.lower_bound, best.lower_bound if best else 0.0)
        best = dataclasses.replace(plan if best is None or plan.sequences < best.sequences else best, lower_bound=bound)
        if best.sequences <= math.ceil(bound - 1e-6):
            break
    return best


def _place(plan: Plan) -> object:
    key = plan.length * (1 << 44) + plan.first_rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("n_tokens", "rank"))
            at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            sequence = plan.first_sequence[at] + (rank - plan.first_rank[at]) // plan.each[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start_token", "n_tokens")), pa.array(sequence)], ["doc_id", "piece", "start_token", "n_tokens", "sequence_id"])

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, sequence_id): where each document or piece goes."""
    sizes = written(token_counts(documents, vocabulary or default_vocabulary()), "sizes")
    cut = F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_tokens - 1) div {capacity} as int)")))
    pieces = sizes.where("n_tokens > 0").select("doc_id", cut.alias("piece"), "n_tokens")
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece").cast("long") * capacity).cast("long").alias("n_tokens"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)))
    parts = pieces.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    plan = pack_histogram({int(r[0]): int(r[1]) for r in parts.groupBy("n_tokens").agg(F.sum("n")).collect()}, capacity)  # at most `capacity` rows
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("local", F.row_number().over(local)).join(offsets, ["n_tokens", "bucket"]).select("doc_id", "piece", "start_token", "n_tokens", (F.col("before") + F.col("local") - 1).alias("rank"))
    placed = ranked.mapInArrow(_place(plan), "doc_id long, piece int, start_token long, n_tokens long, sequence_id long")
    empty = sizes.where("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), "n_tokens", F.lit(None).cast("long").alias("sequence_id"))
    return placed.unionByName(empty)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, pieces, used_tokens, unused_tokens): how full each sequence is."""
    return packed.where("sequence_id is not null").groupBy("sequence_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("used_tokens")).withColumn("unused_tokens", F.lit(capacity) - F.col("used_tokens"))
