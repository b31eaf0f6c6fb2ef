"""Problem 2: records that differ only in formatting, by dictionary encoding of their fields.

Plan. A record is the set of its fields: the completion and the sections of the prompt. One pass over the texts reduces each
distinct value that a task meets to its lower-cased letters and digits and writes a 128-bit digest for each field of each row;
texts go no further. The distinct digests are the dictionary: each gets an integer identifier, and a second hash of another
kind, written beside the first, must be the same for all its occurrences, or the job fails. Rows look their identifiers up and
become sorted tuples of integers, which are written and grouped. Values so common that they would crowd one task are fewer
than HOT, whatever the size of the data, and are looked up by broadcast. Groups are counted with map-side aggregation; the
copies of one record are split over SALTS parts, so that no task holds a whole group.

Sections of a plain prompt: the lead, and each labelled section (SECTION_LABELS) whose label begins on its own line, marked
by a heading sign, brackets, emphasis, a colon or a dash, or alone on its line. A prompt that is a JSON object has its
decoded key-value pairs; it never equals a plain one. Rows whose prompt or completion is null or holds no letter or digit
have no record and are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, written
from .shingles import int_lists

SALTS = 64
#: A value is common if more than one field in HOT has it, so there are fewer than HOT of them.
HOT = 1000
_CACHE = 200_000
# The section labels of prompts.
SECTION_LABELS = ("input", "output", "constraints", "notes", "example", "inputs", "outputs", "constraint", "note", "examples")

_PLAIN = re.compile(r"[\W_]+")
_ANY = re.compile(r"[^\W_]")
_LABEL = re.compile(
    r"(?:^|[\n\r\x0b\x0c\x85\u2028\u2029])[^\S\n\r]*[\ufeff\u200b]?"
    r"(?:(?P<mark>\#+[^\S\n\r]*[*_]*|\*+|_+|\[|<|\(|【)[^\S\n\r]*)?"
    rf"(?P<label>{'|'.join(sorted(SECTION_LABELS, key=len, reverse=True))})(?![a-z0-9])(?<!_)"
    r"(?P<end>[^\S\n\r]*(?:[:：\-–—]|[*_\])>】]+[^\S\n\r]*[:：]?|(?=[\n\r]|$)))?",
    re.IGNORECASE,
)


def plain(text: str) -> str:
    """The lower-cased letters and digits of a text."""
    return _PLAIN.sub("", text.lower())


def sections(prompt: str) -> list[tuple[str, str]]:
    """(label, content) of each section, in the order of the prompt; the kind of prompt shows in the labels."""
    if prompt.lstrip("\ufeff \t\r\n")[:1] == "{":
        try:
            pairs = json.loads(prompt.strip("\ufeff \t\r\n"), object_pairs_hook=lambda p: ("object", p), strict=False)
        except (ValueError, RecursionError):
            pairs = None
        if isinstance(pairs, tuple):
            return [("json:" + plain(k), v if isinstance(v, str) else json.dumps(v, sort_keys=True)) for k, v in pairs[1]]
    cuts = [m for m in _LABEL.finditer(prompt) if m["end"] is not None or (m["mark"] or "").startswith("#")]
    starts = [0, *(m.end() for m in cuts)]
    ends = [*(m.start() for m in cuts), len(prompt)]
    return [(label, prompt[a:b]) for label, a, b in zip(["lead", *(m["label"].lower() for m in cuts)], starts, ends)]


class _Digests(dict):
    """Digest and check of a field, worked out once per distinct value while the cache lasts. Keys are hashes of the raw values."""

    def of(self, label: str, value: str) -> tuple[int, int, int]:
        key = xxhash.xxh3_128_intdigest(value, len(label)), label
        found = self.get(key)
        if found is None:
            if len(self) > _CACHE:
                self.clear()
            canonical = f"{label}\x00{plain(value)}".encode()
            digest = xxhash.xxh3_128_digest(canonical) + hashlib.blake2b(canonical, digest_size=8).digest()
            found = self[key] = tuple(np.frombuffer(digest, np.int64).tolist())
        return found


_DIGESTS = _Digests()


def fields(prompt: str | None, completion: str | None) -> list[tuple[str, str]] | None:
    """(label, raw value) of a record's fields; None if it is no case."""
    if prompt is None or completion is None or not _ANY.search(prompt) or not _ANY.search(completion):
        return None
    return [("completion", completion), *sections(prompt)]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows numbered apart from all others, with digests and checks of their fields."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        keep, found = [], []
        for i, (p, c) in enumerate(zip(batch.column("prompt").to_pylist(), batch.column("completion").to_pylist())):
            if (own := fields(p, c)) is not None:
                keep.append(i)
                found.append([_DIGESTS.of(*f) for f in own])
        table = np.array([d for own in found for d in own], np.int64).reshape(-1, 3)
        offsets = np.concatenate([[0], np.cumsum([len(own) for own in found], dtype=np.int64)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(number, number + len(keep))), batch.column("row_id").take(pa.array(keep, pa.int64())), *(int_lists(np.ascontiguousarray(table[:, i]), offsets) for i in range(3))],
            ["number", "row_id", "d0", "d1", "check"],
        )
        number += len(keep)


def dictionary(each: DataFrame) -> DataFrame:
    """(d0, d1, n, id) of the distinct fields (d0, d1, check), written: the number of their occurrences and their integer identifiers."""
    counted = each.groupBy("d0", "d1").agg(F.count("*").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    same = F.when(F.col("low") == F.col("high"), F.monotonically_increasing_id()).otherwise(F.raise_error(F.lit("two values have one digest")).cast("long"))
    return written(counted.select("d0", "d1", "n", same.alias("id")), "dictionary")


def encode(rows: DataFrame) -> DataFrame:
    """(row_id, record array<bigint>) of the rows that are cases, written. rows: row_id bigint, prompt string, completion string; others are ignored."""
    digested = written(rows.select("row_id", "prompt", "completion").mapInArrow(_digested, "number long, row_id long, d0 array<long>, d1 array<long>, check array<long>"), "digests")
    each = digested.select("number", F.explode(F.arrays_zip("d0", "d1", "check")).alias("f")).select("number", "f.*")
    known = dictionary(each)
    total = known.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") * HOT > total
    hot = F.broadcast(known.where(common).select("d0", "d1", F.col("id").alias("hot_id")))  # fewer than HOT rows
    sifted = each.drop("check").join(hot, ["d0", "d1"], "left")
    rare = sifted.where("hot_id is null").select("number", "d0", "d1").join(known.where(~common).select("d0", "d1", "id"), ["d0", "d1"])
    identified = sifted.where("hot_id is not null").select("number", F.col("hot_id").alias("id")).unionByName(rare.select("number", "id"))
    tuples = identified.groupBy("number").agg(F.sort_array(F.collect_list("id")).alias("record"))  # as long as a row has fields
    encoded = written(digested.select("number", "row_id").join(tuples, "number").select("row_id", "record"), "tuples")
    drop_written(digested)
    drop_written(known)
    return encoded


def _parts(encoded: DataFrame) -> DataFrame:
    return encoded.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).groupBy("record", "salt").agg(F.min("row_id").alias("first"), F.count("*").alias("n"))


def records(rows: DataFrame) -> DataFrame:
    """One row per distinct record: (row_id of its first row, copies)."""
    return _parts(encode(rows)).groupBy("record").agg(F.min("first").alias("row_id"), F.sum("n").alias("copies")).select("row_id", "copies")


def copies(rows: DataFrame) -> DataFrame:
    """(row_id, first): every row that repeats a record, with the record's first row."""
    encoded = encode(rows)
    groups = _parts(encoded).groupBy("record").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    parts = groups.select("record", "first", F.explode("salts").alias("salt"))
    salted = encoded.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    return salted.join(parts, ["record", "salt"]).where("row_id <> first").select("row_id", "first")
