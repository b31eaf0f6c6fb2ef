"""Problem 5: passages of held-out items in documents, by q-gram lemma filtering.

Texts are brought to NFKC, freed of format characters and reduced to their words, joined by single spaces. The passages of
an item are its runs of RUN words, or all of it if it has between LEAST and RUN - 1 words; shorter items are no case. A
passage stands in a document if some run of whole words of that document is within `edits` character edits of it; with no
edits the two are equal.

Plan. The items are a stated query set: their q-grams go to every executor, in blocks of bounded size. By the q-gram lemma a
run within `edits` edits of a passage of length w shares at least w + 1 - q - q * edits q-grams with it, on diagonals that lie
within `edits` of the run's first. Shared q-grams are counted for each document, item and band of diagonals, the bands
overlapping by half, and then for each passage; passages that meet their bound are verified by an alignment within the band,
all candidates of a batch at once. Items are indexed in classes of q, so that a short one doesn't shorten the grams of the
others. Nothing of the corpus is shuffled. With more than one block, a first scan keeps the documents that meet the lemma's
bound over all items together, counted in bitmaps of fixed size, and only these are written and scanned for each block.

Null and blank texts contain nothing. Repeated documents are reported each. Very long texts are scanned in parts that overlap
by more than a passage; parts and documents are kept apart, so that no passage is put together from two of them.
"""

from __future__ import annotations

import dataclasses
import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .shingles import WORD

RUN, LEAST = 12, 6
#: Lengths of q-grams; an item takes the longest that its shortest passage and the edits allow.
GRAMS = (16, 12, 8, 6, 4, 3, 2, 1)
BAND = 32
#: Characters of items in one block of the query set, and of text scanned at once.
BLOCK_CHARS, PART_CHARS = 4_000_000, 2_000_000
#: Bits of a bitmap of grams: of one block, and of all blocks.
CELLS, SIEVE_CELLS = 21, 27


@functools.cache
def _format() -> re.Pattern:
    """The characters of Unicode category Cf."""
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cf") + "]+")


def canonical(text: str | None) -> list[str]:
    """The words of a text in its canonical form."""
    if not text:
        return []
    if not text.isascii():
        text = _format().sub("", unicodedata.normalize("NFKC", text))
    return WORD.findall(text.casefold())


@dataclasses.dataclass
class Index:
    """The q-grams of the items of one class. Passages are (start, end) in the bytes of their item, which begin at base[item]."""

    q: int
    ids: list
    letters: np.ndarray
    base: np.ndarray
    passages: list[np.ndarray]
    floors: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    position: np.ndarray
    cells: np.ndarray


def _grams(text: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q bytes."""
    n = len(text) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    at = lambda i: np.ndarray((n,), "<u8", padded, i, (1,))
    if q >= 8:
        return (at(0) ^ (at(q - 8) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (at(0) & np.uint64((1 << 8 * q) - 1)) * np.uint64(0xD6E8FEB86659FD93)


def _cell(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams ^ (grams >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def _bound(length: object, q: int, edits: int) -> object:
    """The q-grams that a passage shares at least with what is within the edits of it."""
    return length + 1 - q * (edits + 1)


def build_indexes(items: list[tuple[object, str | None]], edits: int = 0, run: int = RUN, least: int = LEAST) -> list[Index]:
    """Indexes of (id, text) items, one for each length of grams in use; none if no item is a case.

    Raises if a passage isn't longer than the edits, when everything would be within them.
    """
    classes: dict[int, list] = {}
    for ident, text in items:
        found = canonical(text)
        if len(found) < least:
            continue
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = min(run, len(found))
        passages = np.stack([starts[: len(found) - k + 1], ends[k - 1 :]], 1)
        shortest = int((passages[:, 1] - passages[:, 0]).min())
        if shortest <= edits:
            raise ValueError(f"a passage of {shortest} characters and {edits} edits")
        q = next(q for q in GRAMS if q * (edits + 1) <= shortest)
        classes.setdefault(q, []).append((ident, np.frombuffer(" ".join(found).encode(), np.uint8), passages, _bound(shortest, q, edits)))
    made = []
    for q, members in classes.items():
        ids, texts, passages, floors = zip(*members)
        each = [_grams(t, q) for t in texts]
        grams = np.concatenate(each)
        item = np.repeat(np.arange(len(ids)), [len(g) for g in each])
        position = np.concatenate([np.arange(len(g)) for g in each])
        order = np.argsort(grams, kind="stable")
        grams, item, position = grams[order], item[order], position[order]
        distinct, first = np.unique(grams, return_index=True)
        cells = np.zeros(1 << CELLS, bool)
        cells[_cell(distinct, CELLS)] = True
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        made.append(Index(q, list(ids), np.concatenate(texts), base, list(passages), np.array(floors), distinct, np.append(first, len(grams)), item, position, cells))
    return made


def hits(index: Index, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in the text, item, position in the item) of each shared q-gram."""
    g = _grams(text, index.q)
    if not len(g):
        return (np.empty(0, np.int64),) * 3
    maybe = np.flatnonzero(index.cells[_cell(g, CELLS)])
    g = g[maybe]
    at = np.searchsorted(index.grams, g)
    at[at == len(index.grams)] = 0
    same = index.grams[at] == g
    maybe, at = maybe[same], at[same]
    count = index.first[at + 1] - index.first[at]
    flat = np.repeat(index.first[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    return np.repeat(maybe, count), index.item[flat], index.position[flat]


def aligned(letters: np.ndarray, at: np.ndarray, length: np.ndarray, text: np.ndarray, start: np.ndarray, edits: int) -> np.ndarray:
    """For each candidate, whether letters[at : at + length] is within `edits` edits of a part of the text that begins at start and
    ends before a space, a zero byte or the end; zero bytes are never part of it.

    One row of the banded table at a time, for all candidates at once: cell k holds the distance of the first i letters to the
    first i + k - edits bytes. Candidates leave as soon as no cell is within the edits.
    """
    far, width = edits + 1, 2 * edits + 1
    room = np.concatenate([np.zeros(edits, np.uint8), text, np.zeros(edits + 1, np.uint8)])  # byte j of the text stands at j + edits
    order = np.argsort(-length, kind="stable")
    at, length, start = at[order], length[order], start[order]
    row = np.full((width, len(order)), far, np.int8)
    row[edits] = 0
    for k in range(edits + 1, width):
        row[k] = np.where(room[start + k - 1] == 0, far, np.minimum(row[k - 1] + 1, far))
    result = np.zeros(len(order), bool)
    live = np.arange(len(order))
    for i in range(int(length.max(initial=0)) + 1):
        done = length[live] == i
        if done.any():
            ends = np.zeros(int(done.sum()), bool)
            for k in range(width):
                after = room[np.minimum(start[live[done]] + i + k, len(room) - 1)]
                ends |= (row[k, done] <= edits) & ((after == 0) | (after == 32))
            result[live[done]] = ends
        stay = ~done & (row.min(0) <= edits) if i % 8 == 0 else ~done
        if not stay.all():
            live, row = live[stay], row[:, stay]
        if not len(live):
            break
        letter, here = letters[at[live] + i], start[live] + i
        new = np.empty_like(row)
        for k in range(width):
            byte = room[np.minimum(here + k, len(room) - 1)]
            best = row[k] + (byte != letter)
            if k:
                best = np.minimum(best, new[k - 1] + 1)
            best = np.where(byte == 0, far, best)
            if k + 1 < width:
                best = np.minimum(best, row[k + 1] + 1)
            new[k] = np.minimum(best, far)
        row = new
    verdict = np.empty(len(order), bool)
    verdict[order] = result
    return verdict


def _candidates(index: Index, text: np.ndarray, starts: np.ndarray, edits: int) -> Iterator[np.ndarray]:
    """Rows (document * items + item, shared grams, begin of the passage in the letters, its length, begin in the text)."""
    where, item, position = hits(index, text)
    if not len(where):
        return
    ends = np.append(starts[1:], len(text) + 1) - 1
    document = np.searchsorted(starts, where, "right") - 1
    diagonal, pair = where - position, document * len(index.ids) + item
    gap = (text == 32) | (text == 0)
    begins = np.concatenate([[True], gap[:-1]]) & ~gap
    wide = max(BAND, 8 * edits)
    for shift in (0, wide // 2):
        band = (diagonal + shift) // wide
        order = np.lexsort((position, band, pair))
        p, b = pair[order], band[order]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (b[1:] != b[:-1])]))
        count = np.diff(np.append(first, len(order)))
        for f in np.flatnonzero(count >= index.floors[p[first] % len(index.ids)]):
            mine = order[first[f] : first[f] + count[f]]
            i, d = int(item[mine[0]]), int(document[mine[0]])
            own, at = index.passages[i], position[mine]
            shared = np.searchsorted(at, own[:, 1] - index.q, "right") - np.searchsorted(at, own[:, 0])
            own, shared = own[enough := shared >= _bound(own[:, 1] - own[:, 0], index.q, edits)], shared[enough]
            if len(own):
                low, high = int(diagonal[mine].min()), int(diagonal[mine].max())
                begin = own[:, :1] + np.arange(low - edits, high + edits + 1)
                begin[(begin < starts[d]) | (begin >= ends[d])] = -1
                which, offset = np.nonzero((begin >= 0) & begins[begin])
                yield np.stack([np.full(len(which), p[first[f]]), shared[which], index.base[i] + own[which, 0], own[which, 1] - own[which, 0], begin[which, offset]], 1)


def leaked(index: Index, text: np.ndarray, starts: np.ndarray, edits: int) -> set[tuple[int, int]]:
    """(document, item) of each item with a passage in a document. The documents begin at starts, each but the first after a zero byte."""
    rows = list(_candidates(index, text, starts, edits))
    if not rows:
        return set()
    rows = np.concatenate(rows)
    rows = rows[np.lexsort((-rows[:, 1], rows[:, 0]))]
    best = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
    check = lambda part: part[aligned(index.letters, part[:, 2], part[:, 3], text, part[:, 4], edits), 0]
    sure = check(rows[best])  # the likeliest candidate of each pair first
    rest = rows[~best]
    found = np.unique(np.concatenate([sure, check(rest[~np.isin(rest[:, 0], sure)])]))
    return {(int(x) // len(index.ids), int(x) % len(index.ids)) for x in found}


def _parts(batch: pa.RecordBatch, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Canonical texts with a zero byte between them: (bytes, where each begins, their ids)."""
    made: list[bytes] = []
    starts, ids, size = [], [], 0
    for ident, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        whole = " ".join(canonical(text)).encode()
        for at in range(0, max(len(whole), 1), PART_CHARS):
            low = whole.rfind(b" ", 0, at - overlap) + 1 if at > overlap else 0
            high = whole.find(b" ", at + PART_CHARS + overlap)
            piece = whole[low : high if high >= 0 else len(whole)]
            starts.append(size)
            ids.append(ident)
            made.append(piece)
            size += len(piece) + 1
            if size > PART_CHARS:
                yield np.frombuffer(b"\0".join(made), np.uint8), np.array(starts), ids
                made, starts, ids, size = [], [], [], 0
    if made:
        yield np.frombuffer(b"\0".join(made), np.uint8), np.array(starts), ids


def _overlap(indexes: list[Index], edits: int) -> int:
    return max(int((w[:, 1] - w[:, 0]).max()) for index in indexes for w in index.passages) + edits + 1


def _scan(indexes: list[Index], edits: int) -> object:
    overlap = _overlap(indexes, edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text, starts, ids in _parts(batch, overlap):
                for index in indexes:
                    found.update((ids[d], index.ids[i]) for d, i in leaked(index, text, starts, edits))
            if found:
                docs, tasks = zip(*sorted(found, key=str))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tasks, pa.string())], ["doc_id", "task_id"])

    return run


def _sieve(bitmaps: dict[int, tuple[np.ndarray, int]], overlap: int) -> object:
    """Documents with as many grams in a bitmap as any passage of its class takes. bitmaps: by q, the bits and the least bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = set()
            for text, starts, ids in _parts(batch.select(["doc_id", "text"]).set_column(0, "doc_id", pa.array(range(batch.num_rows))), overlap):
                for q, (bits, bound) in bitmaps.items():
                    cell = _cell(_grams(text, q), SIEVE_CELLS)
                    there = np.flatnonzero(bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
                    count = np.bincount(np.searchsorted(starts, there, "right") - 1, minlength=len(starts))
                    keep.update(ids[i] for i in np.flatnonzero(count >= bound))
            yield batch.take(pa.array(sorted(keep), pa.int64()))

    return run


def leaks(documents: DataFrame, items: DataFrame, edits: int = 0, run: int = RUN, least: int = LEAST) -> DataFrame:
    """(doc_id, task_id), each once: documents (doc_id bigint, text string) that contain a passage of an item (task_id string, prompt string).

    Other columns are ignored, items with a null id or prompt are no case, and empty inputs give an empty result.
    """
    documents = documents.select("doc_id", "text")
    total = items.agg(F.sum(F.length("prompt"))).first()[0] or 0
    blocks = int(total // BLOCK_CHARS) + 1

    def block(number: int) -> list[Index]:
        rows = items.where(F.pmod(F.xxhash64("task_id"), F.lit(blocks)) == number).select("task_id", "prompt").collect()  # bounded by BLOCK_CHARS
        return build_indexes([(r[0], r[1]) for r in rows if r[0] is not None], edits, run, least)

    if blocks > 1:
        bitmaps: dict[int, tuple[np.ndarray, int]] = {}
        overlap = 1
        for indexes in map(block, range(blocks)):
            for index in indexes:
                bits, bound = bitmaps.get(index.q) or (np.zeros(1 << SIEVE_CELLS - 3, np.uint8), 1 << 40)
                cell = _cell(index.grams, SIEVE_CELLS)
                np.bitwise_or.at(bits, cell >> 3, np.uint8(1) << (cell & 7).astype(np.uint8))
                bitmaps[index.q] = bits, min(bound, int(index.floors.min()))
                overlap = max(overlap, _overlap([index], edits))
        if bitmaps:
            documents = written(documents.mapInArrow(_sieve(bitmaps, overlap), "doc_id long, text string"), "suspects")
    found = None
    for number in range(blocks):
        if indexes := block(number):
            part = documents.mapInArrow(_scan(indexes, edits), "doc_id long, task_id string")
            found = part if found is None else found.unionByName(part)
    return (documents.sparkSession.createDataFrame([], "doc_id long, task_id string") if found is None else found).distinct()
