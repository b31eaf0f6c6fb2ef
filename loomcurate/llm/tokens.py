"""Token counts by a public byte-level BPE vocabulary, read from a file whose path is a parameter."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_LONG = 100_000
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


def default_vocabulary() -> str:
    """Path of the 50k byte-level BPE ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@functools.lru_cache(4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    """The text in parts of bounded size. A single space between two words always starts a token, so cuts there change no
    count; only a run of more than _LONG characters without such a space is cut anywhere."""
    at = 0
    while len(text) - at > 2 * _LONG:
        m = _CUT.search(text, at + _LONG, at + 2 * _LONG)
        end = m.start() if m else at + 2 * _LONG
        yield text[at:end]
        at = end
    yield text[at:]


def count_tokens(text: str | None, path: str) -> int:
    return sum(len(encoding(path).encode_ordinary(p)) for p in _pieces(text)) if text else 0


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of documents with doc_id and text; null and empty texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_tokens(t, path) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
