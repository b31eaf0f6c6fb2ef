"""Problem 3: groups of near-duplicate records, by SuperMinHash signatures, banding, verification and union-find.

Plan. Texts become content keys (copies share one), SuperMinHash signatures and band keys. Within a band bucket every text
is first compared only with the bucket's least key, so a bucket costs as many comparisons as it has members; verified links
are contracted to components. Then the members of *different* components that share a bucket are compared: members already
connected are never paired, and no pair that could join two components is left out. Buckets of more than CROWD members, such
as those of texts with common boilerplate, would cost the square of their size: their members meet by prefixes instead. In an
order of shingles from rare to common, two sets of similarity s share one of the first n - s * n + 1 shingles of each, which
is exact and leaves the boilerplate, the last in that order, out of play. A sketch of 64 slots filters candidates in the join,
the shingle sets verify the rest.

A band key collides by r slots: bands_for() lengthens the bands as the collection grows and adds bands so that a pair at
the threshold is found with probability above 0.99. Null texts and texts under three words are in no group of their own
making: they get a group of one row. Texts count as equal by 64-bit keys of their words and as similar by 32-bit hashes of
their shingles. Columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, written
from .components import components
from .shingles import content_key, int_lists, shingle_sets, words
from .sifting import sift
from .superminhash import band_keys, planes, signatures

SHINGLE, SIMILAR = 3, 0.6
SKETCH_SLOTS, SLACK = 64, 3.5
MISS = 0.009
#: Members of a bucket up to which all pairs of its components are compared.
CROWD = 64
#: Counters of shingle frequencies, whatever the number of shingles. Any counts give an order; good ones give an efficient one.
FREQUENCY_CELLS = 1 << 18
_SEEN = 200_000


def bands_for(texts: int, similar: float) -> tuple[int, int]:
    """(rows of a band, bands): longer bands as the collection grows sixteenfold beyond 2^21 texts."""
    rows = 4 + max(0, math.ceil((math.log2(max(texts, 1)) - 21) / 4))
    return rows, math.ceil(math.log(MISS) / math.log(1 - similar**rows))


def sketch_floor(similar: float) -> int:
    """Slots of the sketch that agree at least, at this similarity."""
    p = similar + (1 - similar) / 4
    return math.floor(SKETCH_SLOTS * p - SLACK * math.sqrt(SKETCH_SLOTS * p * (1 - p)))


def _salt(scope: str) -> int:
    return xxhash.xxh3_64_intdigest(scope)


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[str]], np.ndarray, np.ndarray]]:
    """(batch, rows with enough words, their words, their keys, salts of their scopes)."""
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            batch = whole.slice(at, size)
            found = [words(t) for t in batch.column("text").to_pylist()]
            rows = [i for i, w in enumerate(found) if len(w) >= SHINGLE]
            docs = [found[i] for i in rows]
            salts = np.array([_salt(s or "") for s in batch.column("scope").to_pylist()], np.uint64)[rows]
            keys = (np.array([content_key(d) for d in docs], np.int64).view(np.uint64) ^ salts).view(np.int64)
            yield batch, rows, docs, keys, salts


def _coded(rows: int, bands: int) -> Callable:
    """Every row with its key; sketch, bands and shingles only where this task hasn't sent the key yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, at, docs, keys, salts in _batches(batches, 500):
            if len(seen) > _SEEN:
                seen.clear()
            fresh = [j for j, k in enumerate(keys.tolist()) if not (k in seen or seen.add(k))]
            columns: list = [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
            columns[0][at] = keys
            counts = np.zeros(batch.num_rows, np.int64)
            codes, values, sizes = np.empty(0, np.int64), np.empty(0, np.uint32), np.zeros(batch.num_rows, np.int64)
            if fresh:
                values, starts = shingle_sets([docs[j] for j in fresh], SHINGLE)
                sig = signatures(values, starts, max(SKETCH_SLOTS, rows * bands))
                where = np.array(at)[fresh]
                columns[1][where], columns[2][where] = planes(sig).T
                counts[where], sizes[where] = bands, np.diff(starts)
                codes = np.ascontiguousarray(band_keys(sig, rows, salts[fresh])[:, :bands]).ravel()
                values ^= np.repeat(salts[fresh].astype(np.uint32), np.diff(starts))  # keeps the shingles of different scopes apart
            short = np.ones(batch.num_rows, bool)
            short[at] = False
            offsets = lambda n: np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("scope"), pa.array(columns[0], mask=short), pa.array(columns[1]), pa.array(columns[2]), int_lists(codes, offsets(counts)), int_lists(values, offsets(sizes))],
                ["row_id", "scope", "k", "s0", "s1", "bands", "shingles"],
            )

    return run


def _agree(x0: str, x1: str, y0: str, y1: str) -> F.Column:
    return F.lit(SKETCH_SLOTS) - F.bit_count(F.col(x0).bitwiseXOR(F.col(y0)).bitwiseOR(F.col(x1).bitwiseXOR(F.col(y1))))


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("n"), (F.size("x") + F.size("y")).alias("sizes")).where(F.col("n") / (F.col("sizes") - F.col("n")) >= similar).select("a", "b")


def _alike(pairs: DataFrame, sketches: DataFrame, floor: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree in enough slots."""
    a = sketches.select(F.col("k").alias("a"), F.col("s0").alias("a0"), F.col("s1").alias("a1"))
    b = sketches.select(F.col("k").alias("b"), F.col("s0").alias("b0"), F.col("s1").alias("b1"))
    return pairs.join(a, "a").join(b, "b").where(_agree("a0", "a1", "b0", "b1") >= floor).select("a", "b")


def _prefixed(counts: np.ndarray, similar: float) -> Callable:
    """The shingles of which a similar text must share one, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            starts = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy()[starts[0] : starts[-1]]
            size = np.diff(starts)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((values, counts[values & (FREQUENCY_CELLS - 1)], owner))
            rank = np.arange(len(values)) - np.repeat(starts[:-1] - starts[0], size)
            length = size - np.ceil(similar * size - 1e-9).astype(np.int64) + 1
            first = rank < np.repeat(np.minimum(length, size), size)
            kept = np.bincount(owner[first], minlength=len(size))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("k", "c", "s0", "s1")), int_lists(values[order][first].astype(np.int64), np.concatenate([[0], np.cumsum(kept)]))],
                ["k", "c", "s0", "s1", "prefix"],
            )

    return run


def prefixes(texts: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(band, k, c, s0, s1): texts (k, c, s0, s1) by each shingle of their prefixes. Every two with similar sets share a band."""
    rows = texts.join(sets, "k")
    cell = F.col("shingle").bitwiseAND(F.lit(FREQUENCY_CELLS - 1))
    counts = np.zeros(FREQUENCY_CELLS, np.int64)
    for at, n in rows.select(F.explode("shingles").alias("shingle")).groupBy(cell.alias("cell")).count().collect():  # at most FREQUENCY_CELLS rows
        counts[at] = n
    made = rows.select("k", "c", "s0", "s1", "shingles").mapInArrow(_prefixed(counts, similar), "k long, c long, s0 long, s1 long, prefix array<long>")
    return made.select(F.explode("prefix").alias("band"), "k", "c", "s0", "s1")


def _between(members: DataFrame, floor: int) -> DataFrame:
    """Distinct pairs (a, b) of members (band, k, c, s0, s1) of different components c in one bucket whose sketches agree in enough slots.

    Components with one member in a bucket are compared where they meet; larger ones are expanded to their members only
    against other components.
    """
    parts = members.groupBy("band", "c").agg(F.count("*").alias("n"), F.min("k").alias("k"), F.min("s0").alias("s0"), F.min("s1").alias("s1"))
    side = lambda df, tag: df.select("band", *(F.col(x).alias(f"{tag}{x}") for x in ("c", "k", "s0", "s1")))
    agree = _agree("as0", "as1", "bs0", "bs1") >= floor
    ordered = (F.least("ak", "bk").alias("a"), F.greatest("ak", "bk").alias("b"))
    single = parts.where("n = 1")
    small = side(single, "a").join(side(single, "b"), "band").where("ac < bc").where(agree).select(*ordered)
    large = parts.where("n > 1").select("band", F.col("c").alias("ac"))
    meet = large.join(parts.select("band", F.col("c").alias("bc"), "n"), "band").where("ac < bc or (ac > bc and n = 1)").drop("n")
    big = meet.join(side(members, "a"), ["band", "ac"]).join(side(members, "b"), ["band", "bc"]).where(agree).select(*ordered)
    return small.union(big).distinct()


def encoded(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(row_id, scope, k, s0, s1, bands, shingles) of every row, written: its text's key; the rest for each text at least once."""
    n, bands = bands_for(rows.count(), similar)
    return written(rows.mapInArrow(_coded(n, bands), "row_id long, scope string, k long, s0 long, s1 long, bands array<long>, shingles array<int>"), "bands")


def text_groups(coded: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(k, component) of the distinct texts that have a near-duplicate of another text, from encoded()."""
    coded = coded.where(F.size("bands") > 0)
    floor = sketch_floor(similar)
    each = coded.select("k", F.explode("bands").alias("band"))
    buckets = written(each.groupBy("band").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n")).where("a < b"), "buckets")
    several = buckets.where("n > 2").select("band", "a")
    members = written(sift(each, "band", several.select("band")).join(several, "band").distinct(), "members")
    sketches = coded.select("k", "s0", "s1").distinct()
    first = buckets.select("a", "b").union(members.where("k <> a").select("a", F.col("k").alias("b"))).distinct()
    first = written(_alike(first, sketches, floor), "first")
    needed = first.select(F.col("a").alias("k")).union(first.select("b")).union(members.select("k")).distinct()
    sets = sift(coded.select("k", "shingles"), "k", needed).groupBy("k").agg(F.first("shingles").alias("shingles"))
    sets = written(sets, "sets")
    found = components(_verified(first, sets, similar))

    open_rows = members.select("band", "k").join(found.withColumnRenamed("node", "k"), "k", "left").withColumn("c", F.coalesce("component", "k")).drop("component")
    mixed = open_rows.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high").select("band", "n")
    open_rows = written(open_rows.join(mixed, "band").join(sketches, "k"), "mixed")
    meeting = open_rows.where(F.col("n") <= CROWD).select("band", "k", "c", "s0", "s1")
    crowded = open_rows.where(F.col("n") > CROWD).select("k", "c", "s0", "s1").distinct()
    if not crowded.isEmpty():
        meeting = meeting.unionByName(prefixes(crowded, sets, similar))
    more = _verified(_between(meeting, floor).join(first, ["a", "b"], "left_anti"), sets, similar)
    grouped = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    for table in (buckets, members, first, sets, found, open_rows):  # the result no longer depends on them
        drop_written(table)
    return grouped.select(F.col("node").alias("k"), "component")


def near_groups(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(row_id, scope, group_key): rows with the same scope and group_key are connected by links of at least `similar`.

    rows has row_id bigint, text string and scope string; rows of different scopes are never grouped, and a null scope is one of its own. Copies of a text share
    its group. Null, blank and short texts have a null group_key.
    """
    rows = rows.select("row_id", "text", "scope")
    coded = encoded(rows, similar)
    groups = text_groups(coded, similar)
    return coded.select("row_id", "scope", "k").join(groups, "k", "left").select("row_id", "scope", F.coalesce("component", "k").alias("group_key"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """Every two rows of one group: (row_a, row_b), row_a < row_b."""
    a = groups.where("group_key is not null").select("scope", "group_key", F.col("row_id").alias("row_a"))
    return a.join(a.withColumnRenamed("row_a", "row_b"), ["scope", "group_key"]).where("row_a < row_b").select("row_a", "row_b")
