"""Text keys and markup helpers as Spark columns; all run inside the JVM."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)\A```(?:python|py)\s*\n(.*?)\n```\z"
ANY_FENCE = r"(?s)```.*?```"
EXAMPLE = r"(?is)\*\*Sample Input:\*\*\s*```(?:python)?\s*\n(.*?)\n```\s*\*\*Sample Output:\*\*\s*```(?:python)?\s*\n(.*?)\n```"
NUMBERED_EXAMPLE = r"(?is)\*\*Sample Input\s*(\d*):\*\*\s*```(?:python)?\s*\n(.*?)\n```\s*\*\*Sample Output\s*\1:\*\*\s*```(?:python)?\s*\n(.*?)\n```"


@functools.cache
def _folds() -> dict[str, str]:
    """Characters that case folding, but not lower-casing, turns into word characters."""
    every = (chr(i) for i in range(128, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    return {c: c.casefold() for c in every if c.casefold() != c.lower() and any(x.isascii() and x.isalnum() for x in c.casefold())}


def casefold(text: Column) -> Column:
    """Lower case, and the few characters that fold into ASCII letters replaced; equal to full case folding for word keys."""
    folds = _folds()
    replaced = functools.reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), folds.items(), text)
    return F.lower(F.when(text.rlike("[" + "".join(folds) + "]"), replaced).otherwise(text))


def words(text: Column) -> Column:
    """The maximal runs of a-z, 0-9 and _ after case folding; null for null, empty for texts without words."""
    return F.regexp_extract_all(casefold(text), F.lit("[a-z0-9_]+"), F.lit(0))


def normalized(text: Column) -> Column:
    """The words joined by single spaces: the key under which texts count as equal."""
    return F.array_join(words(text), " ")


def key_hash(text: Column) -> Column:
    """SHA-256 of the normalized text, in hex."""
    return F.sha2(normalized(text), 256)


def plain_name(name: Column) -> Column:
    """An identifier's letters and digits after case folding."""
    return F.regexp_replace(casefold(name), "[^a-z0-9]", "")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^[\s\x{1c}-\x{1f}]+", ""), r"(?U)[\s\x{1c}-\x{1f}]+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x{1c}-\x{1f}]+\z", "")


def fenced_code(text: Column) -> Column:
    """The code of a text that is one fenced Python block and nothing else, else null."""
    inner = F.regexp_extract(text, FENCE, 1)
    return F.when(text.rlike(FENCE), inner)


def without_fences(text: Column) -> Column:
    """Without fenced blocks and the words that head samples, for checks of the kind of task only."""
    return F.regexp_replace(F.regexp_replace(text, ANY_FENCE, ""), "(?i)sample input|input format", "")


def examples(text: Column) -> Column:
    """array<struct<input, output>> of fenced sample pairs without numbers."""
    i, o = (F.regexp_extract_all(text, F.lit(EXAMPLE), F.lit(g)) for g in (1, 2))
    return F.zip_with(i, o, lambda a, b: F.struct(a.alias("input"), b.alias("output")))


def numbered_examples(text: Column) -> Column:
    """As examples(); numbers, where given, must be equal in input and output."""
    i, o = (F.regexp_extract_all(text, F.lit(NUMBERED_EXAMPLE), F.lit(g)) for g in (2, 3))
    return F.zip_with(i, o, lambda a, b: F.struct(a.alias("input"), b.alias("output")))


def wrap_prompt(question: Column) -> Column:
    return F.concat(F.lit('"""\n'), question, F.lit('\n"""\n\n'))


def unwrap_prompt(prompt: Column) -> Column:
    """The question of a wrapped prompt; other texts come back unchanged."""
    return remove_suffix(remove_prefix(prompt, '"""\n'), '\n"""\n\n')


def remove_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def remove_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def mentions(text: Column, name: Column) -> Column:
    """Whether the text has the name as a whole word."""
    escaped = F.regexp_replace(name, r"([^A-Za-z0-9_])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?U)\b"), escaped, F.lit(r"\b")))


def contains_any(text: Column, markers: list[str]) -> Column:
    """Whether the case-folded text contains one of the markers."""
    escaped = "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in m.casefold()) for m in markers)
    return casefold(text).rlike(escaped) if markers else F.lit(False)


def html_escape(text: Column) -> Column:
    """Escapes &, <, >, double and single quotes."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def markdown_cell(text: Column) -> Column:
    """A text that keeps to its table cell: bars escaped, line breaks as spaces."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit(r"\|")), r"\R", " ")


def links(text: Column) -> Column:
    """Targets of Markdown links and of href and src attributes."""
    inline = F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+)"), F.lit(1))
    attribute = F.regexp_extract_all(text, F.lit(r"""(?:href|src)=["']([^"']+)"""), F.lit(1))
    return F.concat(inline, attribute)


def string_list(text: Column) -> Column:
    """array<string> of a JSON list whose elements are all strings; null for anything else."""
    each = F.from_json(text, "array<variant>")
    typed = F.forall(F.transform(each, lambda v: F.schema_of_variant(v)), lambda k: k.eqNullSafe(F.lit("STRING")))
    return F.when(typed, F.from_json(text, "array<string>"))


def token_count(text: Column) -> Column:
    """Default length measure: words. Pass another column to the length gates for a real tokenizer."""
    return F.size(words(text))


def ngrams(tokens: Column, n: int) -> Column:
    """The runs of n consecutive tokens, joined by spaces; empty where there are fewer."""
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def splits_cleanly(prompt: Column, answer: Column, tokenize=words) -> Column:
    """Whether the tokens of prompt and answer, one after the other, are the tokens of the joined text. tokenize: column to array."""
    return F.concat(tokenize(prompt), tokenize(answer)).eqNullSafe(tokenize(F.concat(prompt, answer)))
