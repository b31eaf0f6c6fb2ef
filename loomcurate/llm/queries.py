"""Queries of the training-data problems: pN_... over the tables of a folder."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .leakage import leaks
from .neardup import group_pairs, near_groups
from .overlap import overlap_counts, overlaps, row_links
from .packing import fill, pack
from .pii import find_pii, redact_pii
from .records import SECTION_LABELS, copies, records


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _split_rows(spark: SparkSession, folder: str) -> DataFrame:
    sft = _table(spark, folder, "sft").select("row_id", F.col("prompt").alias("text"), F.lit(None).cast("string").alias("name"), "split", "source")
    grpo = _table(spark, folder, "grpo").select("row_id", F.col("prompt").alias("text"), F.col("entry_point").alias("name"), "split", "source")
    return sft.unionByName(grpo)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping rows across splits of sft and grpo."""
    found = overlaps(_split_rows(spark, folder))
    return found.select(F.least("held_out_row", "train_row").alias("row_a"), F.greatest("held_out_row", "train_row").alias("row_b"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of sft records that differ in formatting only, each with the first row of its record."""
    return copies(_table(spark, folder, "sft")).select(F.col("first").alias("row_a"), F.col("row_id").alias("row_b"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per distinct sft record with its number of copies."""
    return records(_table(spark, folder, "sft"))


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    each = [_table(spark, folder, t).select("row_id", F.col("prompt").alias("text"), F.lit(t).alias("scope")) for t in ("grpo", "rl")]
    return each[0].unionByName(each[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every two rows of one near-duplicate group of grpo or of rl."""
    return group_pairs(near_groups(_prompts(spark, folder)))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each row of grpo and rl with the least row of its group and the group's size; short and null prompts stand alone."""
    groups = near_groups(_prompts(spark, folder))
    sizes = groups.where("group_key is not null").groupBy("scope", "group_key").agg(F.min("row_id").alias("group_id"), F.count("*").alias("rows"))
    joined = groups.join(sizes, ["scope", "group_key"], "left")
    return joined.select("scope", "row_id", F.coalesce("group_id", "row_id").alias("group_id"), F.coalesce("rows", F.lit(1)).alias("rows"))


def p4_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """The training sequence of every document or piece."""
    return pack(_table(spark, folder, "documents"))


def p4_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full each training sequence is."""
    return fill(p4_sequences(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages of evaluation prompts."""
    return leaks(_table(spark, folder, "documents"), _table(spark, folder, "evaluation"))


def p5_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages of evaluation prompts that differ by at most two characters."""
    return leaks(_table(spark, folder, "documents"), _table(spark, folder, "evaluation"), edits=2)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal information of the five types of the problem in documents, each distinct span once per document."""
    return find_pii(_table(spark, folder, "documents"), types=("email", "phone", "id_number", "street_address", "person_name"))


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with typed placeholders in place of personal information."""
    return redact_pii(_table(spark, folder, "documents"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping row pairs per held-out split and source of the held-out row, and rows concerned."""
    return overlap_counts(_split_rows(spark, folder), ["split", "source"])


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """Each row of the three splits of sft and grpo with the class of its text and the number of rows across the split that it overlaps with."""
    return row_links(_split_rows(spark, folder))


_ALL = (p1_found, p1_report, p1_links, p2_found, p2_records, p3_found, p3_groups, p4_sequences, p4_fill, p5_found, p5_edited, p6_found, p6_redacted)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_WORDS = "regexp_extract_all(lower(replace(prompt, 'ß', 'ss')), '[a-z0-9_]+')"


def _similarity_sql(rows: str, allowed: str) -> str:
    """CTEs up to j (a, b, named, similarity): pairs of rows a < b with a common shingle that are allowed to meet."""
    return f"""WITH RECURSIVE w AS (SELECT *, {_WORDS} AS w FROM ({rows})),
s AS (SELECT DISTINCT row_id, tab, held, name, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)),
n AS (SELECT row_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.row_id AS a, y.row_id AS b, bool_or(x.name <> '' AND x.name = y.name) AS named, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.row_id < y.row_id AND {allowed} GROUP BY 1, 2),
j AS (SELECT a, b, named, c / (p.n + q.n - c) AS similarity FROM c JOIN n p ON p.row_id = a JOIN n q ON q.row_id = b)"""


_P1 = _similarity_sql(
    """SELECT row_id, prompt, 'x' AS tab, split <> 'train' AS held, '' AS name FROM sft WHERE split IN ('train', 'valid', 'test') UNION ALL
SELECT row_id, prompt, 'x', split <> 'train', regexp_replace(lower(coalesce(entry_point, '')), '[^a-z0-9]', '', 'g') FROM grpo WHERE split IN ('train', 'valid', 'test')""",
    "x.held <> y.held",
)
_P1_PAIRS = "SELECT a, b FROM j WHERE similarity >= 0.6 OR (named AND similarity >= 0.35)"


def _compatible_sql(column: str) -> str:
    """A text in SQL as leakage.canonical() sees it, as far as word characters go: composed, without format characters, and with the
    characters that NFKC turns into word characters replaced, those that become several by one replacement each."""
    single, several = {}, {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]):
        plain = unicodedata.normalize("NFKC", c).casefold()
        if plain != c.lower() and re.search("[a-z0-9_]", plain):
            (single if len(plain) == 1 else several)[c] = plain
    text = f"translate({column}, '{''.join(single)}', '{''.join(single.values())}')"
    for c in "ﬀﬁﬂﬃﬄﬅﬆ":
        text = f"replace({text}, '{c}', '{several[c]}')"
    return f"regexp_replace(replace(nfc_normalize({text}), 'ß', 'ss'), '\\p{{Cf}}+', '', 'g')"


def _records_sql() -> str:
    """CTEs up to g (row_id, first): sft rows with the first row of their record."""
    labels = "|".join(sorted(SECTION_LABELS, key=len, reverse=True))
    start, mark = r"(?:^|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}])[^\S\n\r]*[\x{feff}\x{200b}]?", r"(?:(?:\#+[^\S\n\r]*[*_]*|\*+|_+|\[|<|\(|【)[^\S\n\r]*)?"
    signed = rf"{start}{mark}({labels})[^\S\n\r]*(?:[:：\-–—]|[*_\])>】]+[^\S\n\r]*[:：]?)"
    alone = rf"{start}{mark}({labels})[^\S\n\r]*([\n\r]|$)"
    headed = rf"{start}\#+[^\S\n\r]*[*_]*[^\S\n\r]*({labels})([^a-z0-9]|$)"
    cut = "prompt"
    for rule, kept in ((signed, ""), (alone, r"\2"), (alone, r"\2"), (headed, r"\2")):  # twice, as two labels may share a line end
        cut = f"regexp_replace({cut}, '(?i){rule}', chr(1) || '\\1' || chr(2) || '{kept}', 'g')"
    plain = lambda c: f"regexp_replace(lower({c}), '[^\\pL\\pN]+', '', 'g')"
    key_value = f"""'json:' || {plain("k")} || ':' || {plain("coalesce(json_extract_string(j, '$." + chr(34) + "' || k || '" + chr(34) + "'), '')")}"""
    return f"""WITH r AS (SELECT row_id, prompt, {plain("completion")} AS c, try_cast(CASE WHEN regexp_matches(prompt, '^[\\x{{feff}}\\s]*\\{{') THEN trim(prompt, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) END AS JSON) AS j
FROM sft WHERE regexp_matches(prompt, '[\\pL\\pN]') AND regexp_matches(completion, '[\\pL\\pN]')),
s AS (SELECT row_id, c, CASE WHEN json_type(j) = 'OBJECT' THEN list_transform(json_keys(j), lambda k: {key_value})
ELSE list_transform(string_split('lead' || chr(2) || {cut}, chr(1)), lambda x: lower(split_part(x, chr(2), 1)) || ':' || {plain("split_part(x, chr(2), 2)")}) END AS f FROM r),
g AS (SELECT row_id, min(row_id) OVER (PARTITION BY c, list_sort(f)) AS first FROM s)"""


def _leaks_sql() -> str:
    words = lambda column: f"regexp_extract_all(lower({_compatible_sql(column)}), '[a-z0-9_]+')"
    return f"""WITH e AS (SELECT task_id, {words("prompt")} AS t FROM evaluation WHERE task_id IS NOT NULL),
g AS (SELECT task_id, 12 AS n, unnest(list_transform(range(1, len(t) - 10), lambda i: array_to_string(t[i:i + 11], ' '))) AS g FROM e WHERE len(t) >= 12 UNION SELECT task_id, len(t), array_to_string(t, ' ') FROM e WHERE len(t) BETWEEN 6 AND 11),
d AS (SELECT doc_id, {words("text")} AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT DISTINCT n FROM g),
x AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g FROM d, s WHERE len(t) >= n)
SELECT DISTINCT doc_id, task_id FROM x JOIN g USING (g)"""


_P3 = (
    _similarity_sql("SELECT row_id, prompt, 'grpo' AS tab, false AS held, '' AS name FROM grpo UNION ALL SELECT row_id, prompt, 'rl', false, '' FROM rl", "x.tab = y.tab")
    + """, l AS (SELECT a, b FROM j WHERE similarity >= 0.6 UNION SELECT b, a FROM j WHERE similarity >= 0.6),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)"""
)
SQL: dict[str, str] = {
    "p1_found": f"{_P1} SELECT a AS row_a, b AS row_b FROM ({_P1_PAIRS})",
    "p1_report": f"""{_P1}, k AS ({_P1_PAIRS}), t AS (SELECT row_id, split, source FROM sft UNION ALL SELECT row_id, split, source FROM grpo)
SELECT split, source, count(*) AS pairs, count(DISTINCT row_id) AS rows FROM k JOIN t ON t.row_id IN (k.a, k.b) AND t.split <> 'train' GROUP BY 1, 2""",
    "p1_links": f"""{_P1}, k AS ({_P1_PAIRS}), l AS (SELECT a AS row_id FROM k UNION ALL SELECT b FROM k),
t AS (SELECT row_id, prompt FROM sft WHERE split IN ('train', 'valid', 'test') UNION ALL SELECT row_id, prompt FROM grpo WHERE split IN ('train', 'valid', 'test')),
x AS (SELECT row_id, len({_WORDS}) >= 3 AS long, array_to_string({_WORDS}, ' ') AS w FROM t)
SELECT row_id, CASE WHEN long THEN min(row_id) OVER (PARTITION BY long, w) ELSE row_id END AS class_id, (SELECT count(*) FROM l WHERE l.row_id = x.row_id) AS links FROM x""",
    "p2_found": f"{_records_sql()} SELECT first AS row_a, row_id AS row_b FROM g WHERE first <> row_id",
    "p2_records": f"{_records_sql()} SELECT first AS row_id, count(*) AS copies FROM g GROUP BY 1",
    "p5_found": _leaks_sql(),
    "p3_found": f"{_P3} SELECT a AS row_a, b AS row_b FROM reach WHERE a < b",
    "p3_groups": f"""{_P3} SELECT tab AS scope, row_id, coalesce(least(row_id, first), row_id) AS group_id, coalesce(n, 1) AS rows
FROM (SELECT 'grpo' AS tab, row_id FROM grpo UNION ALL SELECT 'rl', row_id FROM rl) LEFT JOIN (SELECT a AS row_id, min(b) AS first, count(DISTINCT b) AS n FROM reach GROUP BY 1) USING (row_id)""",
}
