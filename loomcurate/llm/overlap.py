"""Problem 1: the same or near-same records across splits, by similarity-hash fingerprints.

Plan. One pass over the texts writes, for every row, the 64-bit key of its words and, the first time a task meets it, the
text's fingerprint (simhash.py) and its shingle set; all later steps read this table. Rows of the training side get one join
code per fingerprint segment, rows of the held-out side look up their likeliest codes within a Hamming radius. A hash join on
the codes keeps pairs whose first 192 fingerprint bits are within the Hamming radius of the threshold; the distinct pairs of
*texts* are then verified on their shingle sets, of which a bitmap of the pairs' keys holds back the others. Copies of a text never meet each other row by row before that: every map
task sends a text once, and the pairs are distinct keys.

Records that also share a name need less similarity. Their codes are shorter and hold the name, so that a common name is
split by the segments; one plan, which follows the number of named rows of the whole input, holds for all names. A name hash
or key hash that collides by accident is no pair unless its shingles are similar too.

The result comes in two forms. overlaps() lists row pairs, whose number is the product of the copies on both sides. row_links()
and overlap_counts() work on classes of equal texts, with the sizes of the classes in place of their members.

Nulls, blank texts and texts under three words match nothing. Rows whose split is neither train nor valid or test are left
out. Repeated rows give one pair per pair of row ids. Columns other than those named are ignored.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import simhash
from .shingles import content_key, int_lists, shingle_sets, words
from .sifting import sift

SHINGLE, SIMILAR, SIMILAR_NAMED = 3, 0.6, 0.35
#: Words of the fingerprint compared in the join, and standard deviations allowed beyond the expected Hamming distance.
SHORT_WORDS, SLACK = simhash.FIRST // 64, 3.4
_SEEN = 200_000
#: Rows encoded at once, and codes sent in one batch.
_BATCH, _BATCH_CODES = 1500, 4_000_000
_NAME_SHIFT = 40


def cosine_of(similarity: float) -> float:
    """The least cosine of two sets with this Jaccard similarity."""
    return 2 * similarity / (1 + similarity)


def hamming_radius(similarity: float, bits: int, slack: float = SLACK) -> int:
    p = math.acos(cosine_of(similarity)) / math.pi
    return round(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def code_plan(rows: int) -> tuple[int, int, int]:
    """(bits, tables, probes) for so many rows: at least 0.99 of the pairs at the threshold itself are found by every plan. Longer codes
    meet fewer strangers and need more probes for the same recall; two bits more pay off with every fourfold growth beyond 2^21 rows."""
    if rows <= 1 << 21:
        return 13, 24, 320
    bits = min(22, 14 + 2 * math.ceil((math.log2(rows) - 21) / 2))
    return bits, simhash.TABLES, round(300 * 2 ** ((bits - 14) * 0.75))


def name_plan(rows: int) -> tuple[int, int, int]:
    """(bits, tables, probes) for so many named rows, whatever their names. The recall at similarity 0.35 is 0.998 or more."""
    return (6, 16, 96) if rows <= 1 << 16 else (10, simhash.TABLES, 512) if rows <= 1 << 20 else (14, simhash.TABLES, 4096)


def _name_hash(name: str | None) -> int | None:
    plain = re.sub(r"[^a-z0-9]", "", (name or "").casefold())
    return int(np.uint64(xxhash.xxh3_64_intdigest(plain)).astype(np.int64)) if plain else None


def _encode(size: int) -> Callable:
    """Every row with its key and name hash; fingerprint and shingles only where this task hasn't sent them for the same text, name and side.
    Forgetting some of those only sends them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for whole in batches:
            for low in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(low, _BATCH)
                n = batch.num_rows
                if len(seen) > _SEEN:
                    seen.clear()
                keys, names, fresh, docs = [None] * n, [None] * n, [], []
                for i, (text, name, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "name", "held_out")))):
                    found = words(text)
                    if len(found) >= SHINGLE:
                        keys[i], names[i] = content_key(found), _name_hash(name)
                        if (sign := (keys[i], names[i], side)) not in seen:
                            seen.add(sign)
                            fresh.append(i)
                            docs.append(found)
                sizes, prints = np.zeros(n, np.int64), np.zeros((n, size), np.int64)
                values, starts = shingle_sets(docs, SHINGLE)
                if fresh:
                    sizes[fresh] = np.diff(starts)
                    prints[fresh] = simhash.fingerprints(simhash.projections(values, starts))[:, :size]
                others = [c for c in batch.schema.names if c not in ("text", "name")]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in others), pa.array(keys, pa.int64()), pa.array(names, pa.int64()), *(pa.array(prints[:, i]) for i in range(size)), int_lists(values, np.concatenate([[0], np.cumsum(sizes)]))],
                    [*others, "k", "nm", *(f"f{i}" for i in range(size)), "shingles"],
                )

    return run


class Texts:
    """The encoded rows of an input, written once, with the plans that follow from their number."""

    def __init__(self, rows: DataFrame, similar: float = SIMILAR, similar_named: float = SIMILAR_NAMED, keep: tuple[str, ...] = ()) -> None:
        """rows: row_id bigint, text string, name string (null: none), split string, and the columns to keep for later steps."""
        self.similar, self.similar_named, self.keep = similar, similar_named, keep
        rows = rows.where(F.col("split").isin("train", "valid", "test")).select("row_id", "text", "name", (F.col("split") != "train").alias("held_out"), *(F.col(c).alias(f"keep_{c}") for c in keep))
        total, named = rows.agg(F.count("*"), F.count("name")).first()
        self.plan, self.name_plan = code_plan(total), name_plan(named)
        size = max(-(-(simhash.FIRST + bits * tables) // 64) for bits, tables, _ in (self.plan, self.name_plan))
        fields = [f for f in rows.schema.fields if f.name not in ("text", "name")]
        fields += [T.StructField(c, T.LongType()) for c in ("k", "nm", *(f"f{i}" for i in range(size)))] + [T.StructField("shingles", T.ArrayType(T.IntegerType()))]
        self.rows = written(rows.mapInArrow(_encode(size), T.StructType(fields)), "texts")

    def side(self, held_out: bool) -> DataFrame:
        """The rows of one side that have a key."""
        return self.rows.where((F.col("held_out") == held_out) & F.col("k").isNotNull())

    def sets(self, held_out: bool, keys: DataFrame) -> DataFrame:
        """(k, shingles) of the distinct texts of one side, of those with these keys at least."""
        rows = self.side(held_out).where(F.size("shingles") > 0).select("k", "shingles")
        return sift(rows, "k", keys).groupBy("k").agg(F.first("shingles").alias("shingles"))


def _segment(table: int, bits: int) -> Column:
    """A text's join code in one table, from the words of its fingerprint."""
    word, low = divmod(simhash.FIRST + table * bits, 64)
    value = F.shiftrightunsigned(F.col(f"f{word}"), low)
    if low + bits > 64:
        value = value.bitwiseOR(F.shiftleft(F.col(f"f{word + 1}"), 64 - low))
    return value.bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(table << bits))


def _stored(texts: Texts) -> DataFrame:
    """(k, f0.., code) of the training side. Even codes stand for the text alone, odd ones for the text and its name."""
    (bits, tables, _), (name_bits, name_tables, _) = texts.plan, texts.name_plan
    rows = texts.side(False).where(F.size("shingles") > 0)
    alone = F.array(*(F.shiftleft(_segment(t, bits), 1) for t in range(tables)))
    named = F.array(*(F.shiftleft(_segment(t, name_bits), _NAME_SHIFT).bitwiseXOR(F.col("nm")).bitwiseOR(F.lit(1)) for t in range(name_tables)))
    short = [f"f{i}" for i in range(SHORT_WORDS)]
    return rows.select("k", *short, F.explode(F.when(F.col("nm").isNull(), alone).otherwise(F.concat(alone, named))).alias("code"))


def _probes(plan: tuple[int, int, int], named: tuple[int, int, int], similar: float, similar_named: float) -> Callable:
    """The codes that held-out texts look up, as _stored() has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(_BATCH, _BATCH_CODES // (plan[2] + named[2])))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                lists = batch.column("shingles")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                values = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint32)
                p = simhash.projections(values, offsets - offsets[0])
                codes = simhash.probe_codes(p, *plan[::2], cosine_of(similar), plan[1])[0].reshape(len(p), -1) << 1
                rest = [c for c in batch.schema.names if c not in ("shingles", "nm")]
                made = [(np.arange(len(p)), codes)]
                has = np.flatnonzero(batch.column("nm").is_valid().to_numpy(zero_copy_only=False))
                if len(has):
                    names = batch.column("nm").take(pa.array(has)).to_numpy()
                    own = simhash.probe_codes(p[has], *named[::2], cosine_of(similar_named), named[1])[0].reshape(len(has), -1)
                    made.append((has, (own << _NAME_SHIFT) ^ names[:, None] | 1))
                for at, each in made:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in rest), int_lists(each.astype(np.int64).ravel(), np.arange(len(at) + 1) * each.shape[1])], [*rest, "codes"])

    return run


def alike_texts(texts: Texts) -> DataFrame:
    """(qk, tk, similarity): distinct pairs of a held-out and a training text of at least the lesser threshold. Pairs below the greater one
    are looked for among texts that share a name only."""
    short = [f"f{i}" for i in range(SHORT_WORDS)]
    looked = texts.side(True).where(F.size("shingles") > 0).select("k", "nm", *short, "shingles")
    looked = looked.mapInArrow(_probes(texts.plan, texts.name_plan, texts.similar, texts.similar_named), "k long, " + ", ".join(f"{f} long" for f in short) + ", codes array<long>")
    q = looked.select(F.col("k").alias("qk"), *(F.col(f).alias(f"q{f}") for f in short), F.explode("codes").alias("code"))
    t = _stored(texts).select(F.col("k").alias("tk"), *(F.col(f).alias(f"t{f}") for f in short), "code")
    distance = functools.reduce(operator.add, (F.bit_count(F.col(f"q{f}").bitwiseXOR(F.col(f"t{f}"))) for f in short))
    radius = F.when(F.col("code").bitwiseAND(F.lit(1)) == 0, hamming_radius(texts.similar, simhash.FIRST)).otherwise(hamming_radius(texts.similar_named, simhash.FIRST))
    pairs = written(q.join(t, "code").where(distance <= radius).select("qk", "tk").distinct(), "candidates")
    own = lambda held_out, tag: texts.sets(held_out, pairs.select(f"{tag}k")).select(F.col("k").alias(f"{tag}k"), F.col("shingles").alias(f"{tag}s"))
    both = pairs.join(own(True, "q"), "qk").join(own(False, "t"), "tk")
    both = both.select("qk", "tk", F.size(F.array_intersect("qs", "ts")).alias("shared"), (F.size("qs") + F.size("ts")).alias("sizes"))
    return both.select("qk", "tk", (F.col("shared") / (F.col("sizes") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= min(texts.similar, texts.similar_named))


def overlaps(rows: DataFrame, similar: float = SIMILAR, similar_named: float = SIMILAR_NAMED) -> DataFrame:
    """Pairs of rows across splits: (held_out_row, train_row, similarity).

    rows has row_id bigint, text string, name string (null: none) and split string; see the module's text for the rules.
    Two texts match at Jaccard similarity `similar` of their three-word shingles, or at `similar_named` if both rows carry
    the same name (compared as letters and digits of the case-folded name). An empty input gives an empty result.
    """
    texts = Texts(rows, similar, similar_named)
    q, t = texts.side(True), texts.side(False)
    return (
        alike_texts(texts)
        .join(q.select(F.col("row_id").alias("held_out_row"), F.col("k").alias("qk"), F.col("nm").alias("qn")), "qk")
        .join(t.select(F.col("row_id").alias("train_row"), F.col("k").alias("tk"), F.col("nm").alias("tn")), "tk")
        .where((F.col("similarity") >= similar) | ((F.col("qn") == F.col("tn")) & (F.col("similarity") >= similar_named)))
        .select("held_out_row", "train_row", "similarity")
    )


def _linked(texts: Texts, alike: DataFrame, held_out: bool) -> DataFrame:
    """(row_id, keep_..., k, links): the rows of one side with the number of their partners, from the sizes of the partners' classes."""
    mine, other = ("qk", "tk") if held_out else ("tk", "qk")
    sizes = texts.side(not held_out).groupBy(F.col("k").alias(other), F.col("nm").alias("name")).agg(F.count("*").alias("n"))
    whole = sizes.groupBy(other).agg(F.sum("n").alias("n"))
    strong = alike.where(F.col("similarity") >= texts.similar).join(whole, other).groupBy(F.col(mine).alias("k")).agg(F.sum("n").alias("strong"))
    weak = alike.where((F.col("similarity") < texts.similar) & (F.col("similarity") >= texts.similar_named)).join(sizes.where("name is not null"), other)
    # The partners' names that occur on this side, too, and the links they add there.
    here = texts.side(held_out).where("nm is not null").select(F.col("k").alias(mine), F.col("nm").alias("name")).distinct()
    weak = weak.join(here, [mine, "name"]).groupBy(F.col(mine).alias("k"), F.col("name").alias("nm")).agg(F.sum("n").alias("weak"))
    joined = texts.side(held_out).select("row_id", *(f"keep_{c}" for c in texts.keep), "k", "nm").join(strong, "k", "left").join(weak, ["k", "nm"], "left")
    return joined.select("row_id", *(f"keep_{c}" for c in texts.keep), "k", (F.coalesce("strong", F.lit(0)) + F.coalesce("weak", F.lit(0))).alias("links"))


def row_links(rows: DataFrame, similar: float = SIMILAR, similar_named: float = SIMILAR_NAMED) -> DataFrame:
    """(row_id, class_id, links), a row for each row of train, valid and test: the least row of those with the same words, and the number of
    rows across the split that it overlaps with. Short and null texts have their own row_id as class and no links. rows as in overlaps()."""
    texts = Texts(rows, similar, similar_named)
    alike = written(alike_texts(texts), "alike")
    linked = _linked(texts, alike, True).unionByName(_linked(texts, alike, False))
    classes = texts.rows.where("k is not null").groupBy("k").agg(F.min("row_id").alias("class_id"))
    short = texts.rows.where("k is null").select("row_id", F.col("row_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return linked.join(classes, "k").select("row_id", "class_id", "links").unionByName(short)


def overlap_counts(rows: DataFrame, by: list[str], similar: float = SIMILAR, similar_named: float = SIMILAR_NAMED) -> DataFrame:
    """(by..., pairs, rows): overlapping row pairs and held-out rows concerned, for each value of the columns `by` of the held-out row.
    Counted from class sizes: no pair of rows is made. rows as in overlaps(), with the columns `by`."""
    texts = Texts(rows, similar, similar_named, tuple(by))
    linked = _linked(texts, written(alike_texts(texts), "alike"), True).where("links > 0")
    return linked.groupBy(*(F.col(f"keep_{c}").alias(c) for c in by)).agg(F.sum("links").alias("pairs"), F.count("*").alias("rows"))
