"""Queries over sources, gates, joins, selections and samples. Scores and verdicts, which the tables lack, are worked out from ids
and lengths by the same formula on both sides; they stand in for the output of a judge."""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as X
from ..operators import decontaminate as D
from ..operators import gates as G
from ..operators import sampling as P
from ..operators import select as S
from ..session import new_path, written
from ..sources import tables as IO
from .registry import Tables, query

W = "regexp_extract_all(lower(replace({}, 'ß', 'ss')), '[a-z0-9_]+')"
NORM = "array_to_string(" + W + ", ' ')"
LAST_SFT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY row_id DESC) AS rn FROM sft) WHERE rn = 1)"


def last_sft(t: Tables) -> DataFrame:
    return D.last_per_key(t.sft, "source_id", "row_id")


# ---- sources


@query("s1_1_shard_scan", "SELECT count(*) AS rows, count(*) AS ordinals, count(*) - 1 AS last FROM sft")
def shard_scan(t):
    return IO.read_shard(t.spark, f"{t.folder}/sft.parquet").withColumn("f", F.col("_metadata.file_path")).groupBy("f").agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("d"), F.max("ordinal").alias("m")).agg(F.sum("n").alias("rows"), F.sum("d").alias("ordinals"), (F.sum(F.col("m") + 1) - 1).alias("last"))


@query("s1_2_jsonl_round_trip", "SELECT row_id, source_id, prompt, len(tests) AS tests, entry_point FROM grpo")
def jsonl_round_trip(t):
    path = new_path(t.spark, "grpo-jsonl")
    IO.write_jsonl(t.grpo.select("row_id", "source_id", "prompt", "tests", "entry_point"), path)
    back = IO.read_jsonl(t.spark, path, "row_id long, source_id string, prompt string, tests array<string>, entry_point string")
    return back.select("row_id", "source_id", "prompt", F.when(F.col("tests").isNotNull(), F.size("tests")).alias("tests"), "entry_point")


@query("s1_3_indexed", "SELECT task_id, suite, entry_point FROM evaluation")
def indexed(t):
    return IO.indexed(t.evaluation, "task_id").select("task_id", "suite", "entry_point")


@query("s1_3b_last_duplicate", "SELECT sample_id, stage, task_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY received_at DESC) AS rn FROM samples) WHERE rn = 1")
def last_duplicate(t):
    return D.last_per_key(t.samples, "sample_id", "received_at").select("sample_id", "stage", "task_id")


@query("s1_8_file_hashes")
def file_hashes(t):
    return IO.binary_sha256(t.spark, f"{t.folder}/evaluation.parquet")


def _fingerprint_sql(table: str, columns: str) -> str:
    """A table's rows and fingerprint; columns in order of their names."""
    each = ", ".join(f"CASE WHEN {c} IS NULL THEN '{{}}' ELSE '{{\"v\":' || to_json({c})::varchar || '}}' END" for c in columns.split())
    part = lambda i: f"sum(cast('0x' || substr(h, {1 + 8 * i}, 8) AS bigint))::hugeint::varchar"
    return f"SELECT '{table}' AS name, count(*) AS rows, sha256(concat_ws(',', {', '.join(map(part, range(4)))})) AS fingerprint FROM (SELECT sha256(concat_ws(chr(31), {each})) AS h FROM {table})"


@query("s1_9_fingerprints", _fingerprint_sql("evaluation", "entry_point prompt suite task_id") + " UNION ALL " + _fingerprint_sql("grpo", "entry_point prompt row_id source_id"))
def fingerprints(t):
    each = [IO.fingerprint(df).select(F.lit(n).alias("name"), "rows", "fingerprint") for n, df in (("evaluation", t.evaluation), ("grpo", t.grpo.select("row_id", "source_id", "prompt", "entry_point")))]
    return each[0].unionByName(each[1])


@query("s1_9b_fingerprint_values")
def fingerprint_values(t):
    """The fingerprints themselves, of every table that a lock binds."""
    each = [IO.fingerprint(getattr(t, n)).select(F.lit(n).alias("name"), "rows", "fingerprint") for n in ("evaluation", "grpo", "rl", "sft")]
    return functools.reduce(DataFrame.unionByName, each)


@query("s1_6_refuse_overwrite", "SELECT count(*) AS rows, true AS refused FROM evaluation")
def refuse_overwrite(t):
    """The rows of a data set after a second write to its place was refused."""
    path = new_path(t.spark, "once")
    IO.write_jsonl(t.evaluation.select("task_id"), path)
    refused = False
    try:
        IO.write_jsonl(t.evaluation.select("task_id").limit(1), path)
    except AnalysisException:
        refused = True
    return IO.read_jsonl(t.spark, path, "task_id string").agg(F.count("*").alias("rows"), F.lit(refused).alias("refused"))


@query("s1_7_publish", "SELECT split, count(*) AS rows FROM rl GROUP BY 1")
def publish(t):
    """A data set published as a numbered version, by splits."""
    return t.spark.read.parquet(IO.new_version(t.rl.select("row_id", "split"), new_path(t.spark, "versions"))).groupBy("split").agg(F.count("*").alias("rows"))


def _lock(t: Tables, facts: dict, **tables: DataFrame) -> dict:
    """A lock written and read again."""
    path = f"{new_path(t.spark, 'lock')}/data.lock.json"
    IO.write_lock(IO.lock_of(tables, **facts), path, t.spark)
    return IO.read_lock(path, t.spark)


@query("s1_10_verified_manifest", "SELECT suite, count(*) AS tasks FROM evaluation GROUP BY 1")
def verified_manifest(t):
    """The evaluation's tasks after its fingerprint and the facts that its lock binds were found right."""
    stated = _lock(t, {"revision": "r1"}, evaluation=t.evaluation)
    return IO.locked(t.evaluation, stated, "evaluation", {"revision": "r1"}).groupBy("suite").agg(F.count("*").alias("tasks"))


@query("s1_11_lock", "SELECT 'rl' AS name, count(*) AS rows, 64 AS digits, 'r1' AS revision FROM rl UNION ALL SELECT 'evaluation', count(*), 64, 'r1' FROM evaluation")
def lock(t):
    stated = _lock(t, {"revision": "r1"}, rl=t.rl, evaluation=t.evaluation)
    return t.spark.createDataFrame([(n, x["rows"], len(x["fingerprint"]), stated["revision"]) for n, x in stated["tables"].items()], "name string, rows long, digits int, revision string")


@query("s1_12_rebuild", "SELECT row_id, split FROM rl WHERE tests IS NOT NULL")
def rebuild(t):
    """A version built again from its archived input: doing so twice gives the same, as the first output isn't taken for the input."""
    root = new_path(t.spark, "versions")
    first = t.rl.select("row_id", "split", "tests")
    IO.new_version(first, root)
    stated = IO.fingerprint(first).first().asDict()
    build = lambda df: df.where("tests is not null").withColumn("passes", (F.col("passes") if "passes" in df.columns else F.lit(0)) + 1)
    IO.rebuilt(t.spark, root, stated, build)
    return t.spark.read.parquet(IO.rebuilt(t.spark, root, stated, build)).where("passes = 1").select("row_id", "split")


@query("s1_13_frozen_tasks", "SELECT suite, task_id, prompt, entry_point FROM evaluation")
def frozen_tasks(t):
    return IO.frozen_tasks({s: t.evaluation.where(F.col("suite") == s) for s in ("stepwise", "longform")})


# ---- gates


@query(
    "s2_1_waterfall",
    f"""SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN prompt IS NULL OR {NORM.format('prompt')} = '' THEN 'no_prompt' WHEN completion IS NULL THEN 'no_completion'
    WHEN coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) NOT BETWEEN 1 AND 200 THEN 'too_long' WHEN source IS NULL THEN 'no_source' END AS reason FROM sft) GROUP BY 1""",
)
def waterfall(t):
    size = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    gates = [("no_prompt", X.normalized(F.col("prompt")) != ""), ("no_completion", F.col("completion").isNotNull()), ("too_long", size.between(1, 200)), ("no_source", F.col("source").isNotNull())]
    return G.funnel(G.waterfall(t.sft, gates))


@query("s2_2_all_tests_passed", "SELECT sample_id, received_at, (length(solution) % 3 > 0 AND sample_id % 5 > 0 AND length(raw_completion) % 2 = 0) IS TRUE AS ok FROM samples")
def all_tests_passed(t):
    status = lambda c: F.when(c, F.lit("pass")).when(~c, F.lit("fail"))
    each = F.to_json(F.array(status(F.length("solution") % 3 > 0), status(F.col("sample_id") % 5 > 0)), {"ignoreNullFields": "false"})
    score = F.when(F.length("raw_completion") % 2 == 0, 1.0).otherwise(0.5)
    return t.samples.select("sample_id", "received_at", G.all_tests_passed(score, each).alias("ok"))


@query("s2_3_well_formed", """SELECT row_id, regexp_matches(prompt, '[^\\s]') AND NOT contains(prompt, repeat(chr(34), 3)) AS ok FROM sft WHERE prompt IS NOT NULL AND completion IS NOT NULL""")
def well_formed(t):
    answer = F.concat(F.lit("```python\n"), F.col("completion"), F.lit("\n```\n"))
    return t.sft.where("prompt is not null and completion is not null").select("row_id", G.well_formed(F.col("prompt"), answer).alias("ok"))


@query("s2_4_subset", "SELECT doc_id, lower(coalesce(lang, '')) IN ('en', 'de') AND lower(coalesce(doc_kind, '')) IN ('forum', 'report') AS ok FROM documents")
def subset(t):
    return t.documents.select("doc_id", G.in_subset(F.col("lang"), F.col("doc_kind"), ["EN", "de"], ["Forum", "report"]).alias("ok"))


@query("s2_5_source_filter", "SELECT row_id, source FROM sft WHERE source = 'teacher_rewrites'")
def source_filter(t):
    return t.sft.where(F.col("source") == "teacher_rewrites").select("row_id", "source")


@query(
    "s2_6_evidence",
    "SELECT row_id, row_id % 4 > 0 AND (row_id % 10) / 10.0 >= 0.5 AND row_id % 7 > 0 AND coalesce(len(tests), 0) >= 3 AS ok FROM grpo",
)
def evidence(t):
    chosen = F.when(F.col("row_id") % 4 > 0, 1.0)
    rejected = F.when(F.col("row_id") % 7 > 0, (F.col("row_id") % 10) / 10.0)
    return t.grpo.select("row_id", G.enough_evidence(chosen, rejected, F.col("tests"), 0.5, 3).alias("ok"))


@query("s2_7_exclusions", "SELECT row_id, source_id IN (SELECT source_id FROM rl WHERE source_id IS NOT NULL) AS is_excluded FROM sft WHERE source_id IS NOT NULL")
def exclusions(t):
    return G.excluded(t.sft.where("source_id is not null"), t.rl, "source_id").select("row_id", "is_excluded")


@query("s2_8_markers", "SELECT row_id, regexp_matches(lower(prompt), 'archive|plain python|look at the') AS marked FROM rl WHERE prompt IS NOT NULL")
def markers(t):
    return t.rl.where("prompt is not null").select("row_id", X.contains_any(F.col("prompt"), ["Archive", "plain Python", "look at the"]).alias("marked"))


@query("s2_9_first_text", "SELECT row_id, coalesce(nullif(prompt, ''), nullif(completion, ''), '') AS text FROM sft")
def first_text(t):
    return t.sft.select("row_id", G.first_text(F.col("prompt"), F.col("completion")).alias("text"))


@query("s2_10_length_gate", "SELECT row_id, prompt_tokens + completion_tokens <= 256 AND completion_tokens <= 96 AS ok, prompt_tokens + greatest(completion_tokens, 60) <= 256 AND greatest(completion_tokens, 60) <= 96 AS pair_ok FROM sft WHERE prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL")
def length_gate(t):
    p, c = F.col("prompt_tokens"), F.col("completion_tokens")
    return t.sft.where(p.isNotNull() & c.isNotNull()).select("row_id", G.fits(p, c, 256, 96).alias("ok"), G.pair_fits(p, c, F.lit(60), 256, 96).alias("pair_ok"))


@query("s2_11_length_reason", f"SELECT row_id, CASE WHEN len({W.format('prompt')}) NOT BETWEEN 1 AND 130 THEN 'prompt_over_limit' WHEN completion_tokens > 130 THEN 'reference_over_limit' END AS reason FROM sft")
def length_reason(t):
    return t.sft.select("row_id", G.length_reason(X.token_count(F.col("prompt")), F.col("completion_tokens"), 130).alias("reason"))


@query("s2_12_required_rows", "SELECT split, count(*) AS rows FROM sft WHERE split IN ('train', 'valid') GROUP BY 1")
def required_rows(t):
    return G.require_rows(t.sft, "split", {"train": 5, "valid": 1})


@query("s2_14_wrapped_prompt", """SELECT row_id, repeat(chr(34), 3) || chr(10) || prompt || chr(10) || repeat(chr(34), 3) || chr(10) || chr(10) AS wrapped, prompt AS unwrapped FROM rl""")
def wrapped_prompt(t):
    w = X.wrap_prompt(F.col("prompt"))
    return t.rl.select("row_id", w.alias("wrapped"), X.unwrap_prompt(w).alias("unwrapped"))


# ---- joins


@query("s3_1_split_join", f"SELECT r.row_id, s.row_id AS sft_row, s.split AS sft_split FROM rl r JOIN {LAST_SFT} s USING (source_id)")
def split_join(t):
    s = last_sft(t).select("source_id", F.col("row_id").alias("sft_row"), F.col("split").alias("sft_split"))
    return t.rl.select("row_id", "source_id").join(s, "source_id").drop("source_id")


@query("s3_2_lookup", "SELECT row_id, coalesce(n, 0) AS tests FROM sft LEFT JOIN (SELECT source_id, len(max(tests)) AS n FROM grpo GROUP BY 1) USING (source_id)")
def lookup(t):
    return D.lookup(t.sft.select("row_id", "source_id"), t.grpo, "source_id", "tests").select("row_id", F.size("tests").alias("tests"))


@query("s3_3_mandatory_join", f"SELECT r.source_id FROM rl r LEFT JOIN {LAST_SFT} s USING (source_id) WHERE s.row_id IS NULL OR r.prompt IS DISTINCT FROM s.prompt")
def mandatory_join(t):
    return D.join_violations(t.rl, last_sft(t), "source_id", "prompt")


@query(
    "s3_4_positional_zip",
    "SELECT split, row_id, prompt, row_number() OVER (PARTITION BY split ORDER BY row_id) AS row_number FROM grpo",
)
def positional_zip(t):
    right = t.grpo.select("split", F.col("row_id").alias("right_id"), "prompt")
    return D.zipped(t.grpo.select("split", "row_id"), right, "split", "row_id", "right_id").select("split", "row_id", "prompt", "row_number")


GRAMS = f"""WITH e AS (SELECT {W.format('prompt')} AS t FROM evaluation),
g AS (SELECT unnest(list_transform(range(1, len(t) - 10), lambda i: array_to_string(t[i:i + 11], ' '))) AS g, 12 AS n FROM e WHERE len(t) >= 12 UNION SELECT array_to_string(t, ' '), len(t) FROM e WHERE len(t) BETWEEN 6 AND 11),
d AS (SELECT doc_id, {W.format('text')} AS t FROM documents), s AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g FROM d, s WHERE len(t) >= n)"""


@query("s3_5_eval_overlap", GRAMS + " SELECT DISTINCT doc_id FROM x WHERE g IN (SELECT g FROM g)")
def eval_overlap(t):
    return D.overlapping(t.documents, "doc_id", "text", t.evaluation)


@query("s3_6_name_overlap")
def name_overlap(t):
    return D.named_like(t.sft, "row_id", C.function_names_udf(F.col("completion")), t.evaluation)


@query(
    "s3_6b_entry_overlap",
    """SELECT row_id FROM grpo WHERE regexp_replace(lower(entry_point), '[^a-z0-9]', '', 'g') IN (SELECT regexp_replace(lower(e.entry_point), '[^a-z0-9]', '', 'g') AS n FROM (SELECT entry_point FROM evaluation UNION ALL SELECT entry_point FROM grpo WHERE split <> 'train') e WHERE n <> '')""",
)
def entry_overlap(t):
    """Rows whose function has the name of an evaluation task or of a held-out row."""
    held = t.evaluation.select("entry_point").unionByName(t.grpo.where("split <> 'train'").select("entry_point"))
    return D.named_like(t.grpo, "row_id", F.array("entry_point"), held)


@query("s3_7_held_out_texts", f"SELECT row_id FROM grpo WHERE split = 'train' AND (prompt IS NULL OR {NORM.format('prompt')} NOT IN (SELECT {NORM.format('prompt')} FROM sft WHERE split <> 'train' AND prompt IS NOT NULL))")
def held_out_texts(t):
    return D.without_texts(t.grpo.where("split = 'train'"), "prompt", t.sft.where("split <> 'train'"), "prompt").select("row_id")


@query(
    "s3_8_cross_split_keys",
    f"""WITH k AS (SELECT row_id, split, source_id, sha256({NORM.format('prompt')}) AS prompt_key FROM grpo)
SELECT row_id, source_id IN (SELECT source_id FROM k WHERE split = 'train') AS in_train_source_id, coalesce(prompt_key IN (SELECT prompt_key FROM k WHERE split = 'train' AND prompt_key IS NOT NULL), false) AS in_train_prompt_key FROM k WHERE split = 'valid'""",
)
def cross_split_keys(t):
    k = t.grpo.withColumn("prompt_key", X.key_hash(F.col("prompt")))
    return D.crosses(k.where("split = 'valid'"), k.where("split = 'train'"), ["source_id", "prompt_key"]).select("row_id", "in_train_source_id", "in_train_prompt_key")


@query("s3_9_coverage", "SELECT task_id, count(DISTINCT stage) AS stages FROM (SELECT task_id, stage FROM samples UNION ALL SELECT task_id, 'tasks' FROM evaluation) GROUP BY 1 HAVING count(DISTINCT stage) < 7")
def coverage(t):
    stages = ("base", "full_sft", "lora_sft", "dpo", "ppo", "grpo")
    gaps = D.coverage_gaps({"tasks": t.evaluation} | {s: t.samples.where(F.col("stage") == s) for s in stages}, "task_id")
    return gaps.select("task_id", (7 - F.size("missing_in")).cast("long").alias("stages"))


@query("s3_11_orphans", "SELECT sample_id, s.task_id, e.suite FROM samples s LEFT JOIN evaluation e USING (task_id) WHERE e.task_id IS NULL")
def orphans(t):
    return t.samples.join(t.evaluation.select("task_id", "suite"), "task_id", "left").where("suite is null").select("sample_id", "task_id", "suite")


@query("s3_12_evidence_merge", "SELECT g.row_id, r.row_id AS rl_row, len(r.tests) AS rl_tests FROM grpo g JOIN rl r USING (source_id)")
def evidence_merge(t):
    quality = t.rl.select("source_id", F.struct(F.col("row_id"), F.col("tests")).alias("quality"))
    n = F.when(F.col("quality.tests").isNotNull(), F.size("quality.tests"))
    return t.grpo.select("row_id", "source_id").join(quality, "source_id").select("row_id", F.col("quality.row_id").alias("rl_row"), n.alias("rl_tests"))


# ---- selections


@query(
    "s4_1_first_accepted",
    f"""WITH k AS (SELECT row_id, sha256({NORM.format('prompt')}) AS k, coalesce(completion_tokens <= 100, false) AS ok FROM sft WHERE prompt IS NOT NULL)
SELECT row_id, CASE WHEN row_id > min(CASE WHEN ok THEN row_id END) OVER (PARTITION BY k) THEN 'duplicate_prompt' WHEN NOT ok THEN 'too_long' END AS reason FROM k""",
)
def first_accepted(t):
    rows = written(t.sft.where("prompt is not null").select("row_id", X.key_hash(F.col("prompt")).alias("k"), "completion_tokens"), "keyed")
    return S.first_accepted(rows, "k", "row_id", F.col("completion_tokens") <= 100, "too_long", "duplicate_prompt").select("row_id", "reason")


@query("s4_2_implementation_dedup")
def implementation_dedup(t):
    rows = t.sft.where("completion is not null").select("row_id", C.implementation_key_udf(F.col("completion")).alias("k")).where("k is not null")
    return S.first_seen(rows, "k", "row_id").select("row_id", "is_first")


NAME = "regexp_replace(lower(entry_point), '[^a-z0-9]', '', 'g')"


@query("s4_3_name_cap", f"SELECT row_id, name FROM (SELECT row_id, {NAME} AS name, row_number() OVER (PARTITION BY {NAME} ORDER BY row_id) AS n FROM grpo WHERE entry_point IS NOT NULL) WHERE n <= 5")
def name_cap(t):
    rows = t.grpo.where("entry_point is not null").select("row_id", X.plain_name(F.col("entry_point")).alias("name"))
    return S.capped(rows, "name", ["row_id"], 5)


_KEYED = f"(SELECT row_id, source_id, split, sha256({NORM.format('prompt')}) AS pk, coalesce(sha256(array_to_string(tests, chr(10))), 'none') AS ck, {NAME} AS entry FROM grpo WHERE prompt IS NOT NULL AND entry_point IS NOT NULL)"


@query(
    "s4_4_coupled_greedy",
    f"""WITH RECURSIVE k AS (SELECT *, row_number() OVER (ORDER BY row_id) AS i FROM {_KEYED}),
g AS (SELECT 0::bigint AS i, 0::bigint AS row_id, NULL::varchar AS reason, []::varchar[] AS ps, []::varchar[] AS cs, []::varchar[] AS es UNION ALL
SELECT i, row_id, reason, CASE WHEN reason IS NULL THEN list_append(ps, pk) ELSE ps END, CASE WHEN reason IS NULL THEN list_append(cs, ck) ELSE cs END, CASE WHEN reason IS NULL THEN list_append(es, entry) ELSE es END
FROM (SELECT k.*, ps, cs, es, CASE WHEN list_contains(ps, pk) THEN 'duplicate_prompt' WHEN list_contains(cs, ck) THEN 'duplicate_code' WHEN len(list_filter(es, lambda x: x = k.entry)) >= 5 THEN 'name_cap' END AS reason FROM g JOIN k ON k.i = g.i + 1))
SELECT row_id, reason FROM g WHERE i > 0""",
)
def coupled_greedy(t):
    rows = t.grpo.where("prompt is not null and entry_point is not null").select("row_id", X.key_hash(F.col("prompt")).alias("prompt_key"), F.sha2(F.array_join("tests", "\n"), 256).alias("code_key"), X.plain_name(F.col("entry_point")).alias("name"))
    return S.greedy_reasons(rows, "row_id", {"prompt_key": "duplicate_prompt", "code_key": "duplicate_code"}, {"name": (5, "name_cap")}).select("row_id", "reason")


@query(
    "s4_5_split_selection",
    f"""WITH RECURSIVE k AS (SELECT *, row_number() OVER (ORDER BY split = 'train', row_id) AS i FROM {_KEYED} WHERE split IN ('valid', 'train')),
g AS (SELECT 0::bigint AS i, 0::bigint AS row_id, '' AS split, '' AS entry, false AS ok, []::varchar[] AS ps, []::varchar[] AS ids, []::varchar[] AS es UNION ALL
SELECT i, row_id, split, entry, ok, CASE WHEN ok THEN list_append(ps, pk) ELSE ps END, CASE WHEN ok THEN list_append(ids, source_id) ELSE ids END, CASE WHEN ok THEN list_append(es, split || ':' || entry) ELSE es END
FROM (SELECT k.*, ps, ids, es, NOT list_contains(ps, pk) AND NOT list_contains(ids, k.source_id) AND NOT (k.split = 'train' AND list_contains(es, 'valid:' || k.entry)) AND len(list_filter(es, lambda x: x = k.split || ':' || k.entry)) < 5
AND len(list_filter(es, lambda x: starts_with(x, k.split || ':'))) < CASE k.split WHEN 'valid' THEN 2 ELSE 15 END AS ok FROM g JOIN k ON k.i = g.i + 1))
SELECT row_id, split, entry FROM g WHERE ok""",
)
def split_selection(t):
    """Valid before train, to small targets: both stop there, and a split that missed its target would fail."""
    rows = t.grpo.where("prompt is not null and entry_point is not null").select("row_id", "source_id", "split", X.key_hash(F.col("prompt")).alias("prompt_key"), X.plain_name(F.col("entry_point")).alias("entry"))
    return S.split_selection(rows, "split", "row_id", ["source_id", "prompt_key"], "entry", {"valid": 2, "train": 15}).select("row_id", "split", "entry")


@query(
    "s4_6_recap",
    f"""WITH k AS (SELECT row_id, split, {NAME} AS entry FROM grpo WHERE entry_point IS NOT NULL), v AS (SELECT DISTINCT entry FROM k WHERE split = 'valid')
SELECT row_id, split FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY row_id) AS n FROM k WHERE split = 'train' AND entry NOT IN (SELECT entry FROM v)) WHERE n <= 5 UNION ALL SELECT row_id, split FROM k WHERE split = 'valid'""",
)
def recap(t):
    rows = t.grpo.where("entry_point is not null").select("row_id", "split", X.plain_name(F.col("entry_point")).alias("entry"))
    return S.recapped(rows, "split", "entry", "row_id").select("row_id", "split")


@query("s4_7_distinct_list", "SELECT row_id, (SELECT count(DISTINCT x) FROM unnest(tests) AS u(x)) AS tests FROM grpo WHERE tests IS NOT NULL")
def distinct_list(t):
    return t.grpo.where("tests is not null").select("row_id", F.size(F.array_distinct("tests")).cast("long").alias("tests"))


@query("s4_8_checked_tests")
def checked_tests(t):
    return t.grpo.select("row_id", F.size(C.checked_tests_udf(F.col("tests"))).alias("tests"))


@query("s4_9_first_seen", "SELECT row_id, row_id = min(row_id) OVER (PARTITION BY source_id) AS is_first FROM sft")
def first_seen(t):
    return S.first_seen(t.sft.select("row_id", "source_id"), "source_id", "row_id").select("row_id", "is_first")


@query("s4_10_accept_limit", "SELECT row_id FROM grpo WHERE len(tests) >= 3 ORDER BY row_id LIMIT 100")
def accept_limit(t):
    return P.first_rows(t.grpo.where(F.size("tests") >= 3).select("row_id"), ["row_id"], 100)


@query("s4_11_best_candidate", "SELECT task_id, sample_id, score FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, sample_id) AS n FROM (SELECT task_id, sample_id, max(length(solution) % 10) AS score FROM samples WHERE solution IS NOT NULL AND task_id IS NOT NULL GROUP BY 1, 2)) WHERE n = 1")
def best_candidate(t):
    c = t.samples.where("solution is not null and task_id is not null").groupBy("task_id", "sample_id").agg(F.max(F.length("solution") % 10).alias("score"))
    return S.best_candidate(c, "task_id", "score", "sample_id")


# ---- splits and samples

H = "cast('0x' || substr(sha256({}), 1, 8) AS bigint)"


@query("s5_1_hash_split", f"SELECT row_id, CASE WHEN {H.format(NORM.format('prompt'))} % 20 = 0 THEN 'valid' ELSE 'train' END AS assigned FROM sft WHERE prompt IS NOT NULL")
def hash_split(t):
    return t.sft.where("prompt is not null").select("row_id", P.split_of(X.normalized(F.col("prompt"))).alias("assigned"))


@query("s5_2_salted_split", f"""SELECT row_id, CASE WHEN {H.format("'preference-v1:' || " + NORM.format('prompt'))} % 20 = 0 THEN 'valid' ELSE 'train' END AS assigned FROM sft WHERE prompt IS NOT NULL""")
def salted_split(t):
    return t.sft.where("prompt is not null").select("row_id", P.split_of(X.normalized(F.col("prompt")), salt="preference-v1:").alias("assigned"))


@query("s5_3_sample", "SELECT row_id FROM grpo ORDER BY sha256('42|' || row_id), row_id LIMIT 10")
def sample(t):
    return P.sample(t.grpo.select("row_id"), "row_id", 10, 42)


@query("s5_4_dataset_seeds", f"SELECT DISTINCT suite, xor(42, {H.format('suite')}) AS seed FROM evaluation")
def dataset_seeds(t):
    return t.evaluation.select("suite", P.dataset_seed_column(42, F.col("suite")).alias("seed")).distinct()


@query("s5_5_shuffle", "SELECT row_id, row_number() OVER (ORDER BY sha256('42|' || row_id), row_id) AS position FROM grpo")
def shuffle(t):
    return P.shuffled(t.grpo.select("row_id"), "row_id", 42)


@query("s5_7_epochs", "SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256('7|' || epoch || '|' || task_id), task_id) - 1 AS position, task_id FROM evaluation, range(3) AS r(epoch)")
def epochs(t):
    return P.epochs(t.evaluation, "task_id", 7, 3)


@query("s5_8_first_per_suite", "SELECT suite, task_id FROM (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY task_id) AS n FROM evaluation) WHERE n <= 10")
def first_per_suite(t):
    return P.first_per_group(t.evaluation, "suite", ["task_id"], 10).select("suite", "task_id")


@query("s5_9_manifest", f"SELECT 'evaluation' AS name, count(*) AS available, 'entry_point, prompt, suite, task_id' AS keys, xor(42, {H.format(chr(39) + 'evaluation' + chr(39))}) AS seed FROM evaluation")
def manifest(t):
    return P.manifest(t.evaluation, "evaluation", 42)


# ---- set operations and order


@query("s8_3_sorted_ids", "SELECT source, source_id, row_number() OVER (PARTITION BY source ORDER BY source_id) AS position FROM (SELECT DISTINCT source, source_id FROM grpo WHERE source_id IS NOT NULL)")
def sorted_ids(t):
    """The distinct ids of each source in order, a row each, so that a common source needn't fit into one value."""
    return P.ranked(t.grpo.where("source_id is not null").select("source", "source_id").distinct(), "source", "source_id", "position")


@query("s8_5_shared_ids", "SELECT source_id FROM sft WHERE split = 'train' INTERSECT SELECT source_id FROM sft WHERE split = 'valid'")
def shared_ids(t):
    ids = lambda s: t.sft.where(F.col("split") == s).select("source_id")
    return ids("train").intersect(ids("valid"))


@query("s8_6_missing_ids", "SELECT source_id FROM sft EXCEPT SELECT source_id FROM rl")
def missing_ids(t):
    return t.sft.select("source_id").distinct().join(t.rl.select("source_id").distinct(), "source_id", "left_anti")


@query("s8_7_tagged_union", "SELECT tab, row_id, row_number() OVER (PARTITION BY tab ORDER BY row_id) AS row_number FROM (SELECT 'rl' AS tab, row_id FROM rl UNION ALL SELECT 'grpo', row_id FROM grpo)")
def tagged_union(t):
    each = [df.select(F.lit(n).alias("tab"), "row_id") for n, df in (("rl", t.rl), ("grpo", t.grpo))]
    return P.ranked(each[0].unionByName(each[1]), "tab", "row_id")


# ---- scalars


@query("s9_1_words", f"SELECT doc_id, len({W.format('text')}) AS words, coalesce(array_to_string({W.format('text')}, ' '), '') AS joined FROM documents WHERE text IS NOT NULL")
def words(t):
    return t.documents.where("text is not null").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("words"), X.normalized(F.col("text")).alias("joined"))


@query("s9_2_key_hash", f"SELECT doc_id, sha256({NORM.format('text')}) AS key FROM documents WHERE text IS NOT NULL")
def key_hash(t):
    return t.documents.where("text is not null").select("doc_id", X.key_hash(F.col("text")).alias("key"))


@query("s9_3_fenced_code", "SELECT row_id, regexp_replace(completion, '\\A\\s*\\n', '') AS code FROM sft")
def fenced_code(t):
    return t.sft.select("row_id", X.fenced_code(F.concat(F.lit("```python\n"), F.col("completion"), F.lit("\n```"))).alias("code"))


@query("s9_5_without_fences", "SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '(?i)sample input|input format', '', 'g') AS prose FROM documents")
def without_fences(t):
    return t.documents.select("doc_id", X.without_fences(F.col("text")).alias("prose"))


@query("s9_6_plain_name", f"SELECT row_id, {NAME} AS name FROM grpo")
def plain_name(t):
    return t.grpo.select("row_id", X.plain_name(F.col("entry_point")).alias("name"))


_SAMPLE = "\n**Sample Input 1:**\n```\n3 5\n```\n**Sample Output 1:**\n```\n8\n```\n"


def _with_sample(number_in: str = "", number_out: str = "") -> Column:
    """Prompts with a sample pair of the row's own id and length."""
    block = lambda head, body: F.concat(F.lit("\n**Sample "), head, F.lit(":**\n```\n"), body, F.lit("\n```"))
    i, o = (F.concat(F.lit(name), F.expr(n) if n else F.lit("")) for name, n in (("Input", number_in), ("Output", number_out)))
    return F.concat("prompt", block(i, F.col("row_id").cast("string")), block(o, F.length("prompt").cast("string")), F.lit("\n"))


@query("s9_7_examples", "SELECT row_id, row_id::varchar AS input, length(prompt)::varchar AS output FROM rl WHERE prompt IS NOT NULL")
def examples(t):
    e = F.explode(X.examples(_with_sample()))
    return t.rl.where("prompt is not null").select("row_id", e.alias("e")).select("row_id", "e.input", "e.output")


@query("s9_8_numbered_examples", "SELECT row_id, row_id::varchar AS input, length(prompt)::varchar AS output FROM rl WHERE prompt IS NOT NULL AND row_id % 3 = row_id % 2")
def numbered_examples(t):
    """Pairs count only where both numbers agree."""
    e = F.explode(X.numbered_examples(_with_sample("concat(' ', row_id % 3)", "concat(' ', row_id % 2)")))
    return t.rl.where("prompt is not null").select("row_id", e.alias("e")).select("row_id", "e.input", "e.output")


@query("s9_9_mentions", "SELECT task_id, regexp_matches(prompt, '\\b' || entry_point || '\\b') AS mentioned FROM evaluation")
def mentions(t):
    return t.evaluation.select("task_id", X.mentions(F.col("prompt"), F.col("entry_point")).alias("mentioned"))


@query("s9_10_html_escape", """SELECT sample_id, received_at, replace(replace(replace(replace(replace(solution, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM samples""")
def html_escape(t):
    return t.samples.select("sample_id", "received_at", X.html_escape(F.col("solution")).alias("escaped"))


@query("s9_11_diff")
def diff(t):
    return t.sft.select("row_id", F.length(C.unified_diff_udf(F.col("completion"), F.col("prompt"))).alias("characters"))


_SPACES = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


@query("s9_12_strip", f"SELECT doc_id, trim(text, {_SPACES}) AS stripped, rtrim(text, {_SPACES}) AS right_stripped FROM documents")
def strip(t):
    return t.documents.select("doc_id", X.strip(F.col("text")).alias("stripped"), X.rstrip(F.col("text")).alias("right_stripped"))


@query("s9_13_prefix", "SELECT doc_id, CASE WHEN starts_with(source, 'forum.') THEN substr(source, 7) ELSE source END AS host FROM documents")
def prefix(t):
    return t.documents.select("doc_id", X.remove_prefix(F.col("source"), "forum.").alias("host"))


@query("s9_14_markdown_cell", "SELECT row_id, regexp_replace(replace(completion, '|', '\\|'), '\\r\\n|\\n|\\r|\\x0b|\\x0c|\\x{85}|\\x{2028}|\\x{2029}', ' ', 'g') AS cell FROM sft")
def markdown_cell(t):
    return t.sft.select("row_id", X.markdown_cell(F.col("completion")).alias("cell"))


@query("s9_15_links", "SELECT doc_id, len(regexp_extract_all(text, '\\]\\(([^)\\s]+)', 1)) + len(regexp_extract_all(text, '(?:href|src)=[\"'']([^\"'']+)', 1)) AS links FROM documents WHERE text IS NOT NULL")
def links(t):
    return t.documents.where("text is not null").select("doc_id", F.size(X.links(F.col("text"))).cast("long").alias("links"))


@query("s9_16_string_list", "SELECT row_id, CASE WHEN tests IS NOT NULL THEN len(tests) END AS tests, CASE row_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS others FROM rl")
def string_list(t):
    """Lists of strings; anything else, such as a list that holds a number, is null."""
    n = lambda c: F.when(c.isNotNull(), F.size(c)).cast("long")
    other = F.element_at(F.array(*map(F.lit, ('["a","b"]', "[]", '["a", 1]', '{"a": "b"}', '["a", null]'))), (F.col("row_id") % 5 + 1).cast("int"))
    return t.rl.select("row_id", n(X.string_list(F.to_json("tests"))).alias("tests"), n(X.string_list(other)).alias("others"))


@query("s7_7_ngrams", f"SELECT doc_id, greatest(len({W.format('text')}) - 11, 0) AS grams FROM documents WHERE text IS NOT NULL")
def ngrams(t):
    tokens = t.documents.where("text is not null").select("doc_id", X.words(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size(X.ngrams(F.col("t"), 12)).cast("long").alias("grams"))


# ---- program analysis (no SQL equivalent; tested on literal cases)


@query("s10_1_parses")
def parses(t):
    return t.samples.select("sample_id", "received_at", C.parses_udf(F.col("solution")).alias("parses"), C.has_function_udf(F.col("solution")).alias("has_function"))


@query("s10_2_pair_reason")
def pair_reason(t):
    return t.sft.select("row_id", C.pair_reason_udf(F.col("prompt"), F.col("completion"), C.zero_probe_udf(F.col("completion"))).alias("reason"))


@query("s10_5_implementation_key")
def implementation_key(t):
    return t.samples.select("sample_id", "received_at", C.implementation_key_udf(F.col("solution")).alias("key"))


@query("s10_6_mutations")
def mutations(t):
    m = C.mutations_udf(F.col("completion"), P.hash_number(F.coalesce("source_id", F.lit(""))), 6)
    return t.sft.select("row_id", F.posexplode(m).alias("n", "m")).select("row_id", "n", "m.line", "m.column", "m.old", "m.new")


@query("s10_7_replay")
def replay(t):
    from ..operators.audit import replays

    m = t.sft.select("completion", "row_id", F.explode(C.mutations_udf(F.col("completion"), F.lit(1), 6)).alias("m"))
    return m.groupBy("row_id").agg(F.count("*").alias("mutations"), F.count_if(replays(F.col("completion"), F.col("m.code"), F.col("m.line"), F.col("m.column"), F.col("m.old"), F.col("m.new"))).alias("replayed"))


@query("s10_9_example_tests")
def example_tests(t):
    prompt = F.concat(F.col("prompt"), F.lit(_SAMPLE))
    return t.sft.where("prompt is not null").select("row_id", F.size(C.example_tests_udf(prompt, F.col("completion"), X.numbered_examples(prompt))).alias("tests"), F.size(X.numbered_examples(prompt)).alias("matched"))


@query("s10_10_probes")
def probes(t):
    return t.sft.select("row_id", C.null_probe_udf(F.col("completion")).alias("null_probe"), C.zero_probe_udf(F.col("completion")).alias("zero_probe"))


@query("s10_12_public_entry")
def public_entry(t):
    rows = t.grpo.select("row_id", "source_id", "tests", "entry_point").join(last_sft(t).select("source_id", "completion"), "source_id")
    return rows.select("row_id", "entry_point", C.public_entry_udf(F.col("completion"), F.col("tests")).alias("entry"), C.tests_call_function_udf(F.col("completion"), F.col("tests")).alias("all_call"))


@query("s10_13_static_facts")
def static_facts(t):
    rows = t.samples.join(t.evaluation.select("task_id", "entry_point"), "task_id")
    return rows.select("sample_id", "received_at", C.static_facts_udf(F.col("solution"), F.col("entry_point")).alias("f")).select("sample_id", "received_at", "f.*")


@query("s10_14_first_function")
def first_function(t):
    return t.sft.select("row_id", C.first_function_udf(F.col("completion")).alias("name"), C.bare_code_udf(F.col("completion")).alias("code"))


# ---- the flagship: decontaminated, deduplicated, split corpus


@query(
    "curated_corpus",
    GRAMS
    + f""", h AS (SELECT DISTINCT doc_id FROM x WHERE g IN (SELECT g FROM g)),
k AS (SELECT doc_id, {NORM.format('text')} AS key, len({W.format('text')}) BETWEEN 6 AND 4000 AS ok FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM h)),
r AS (SELECT doc_id, key, CASE WHEN doc_id > min(CASE WHEN ok THEN doc_id END) OVER (PARTITION BY key) THEN 'duplicate' WHEN NOT ok THEN 'length' END AS reason FROM k),
f AS (SELECT coalesce(reason, CASE WHEN {H.format('key')} % 20 = 0 THEN 'valid' ELSE 'train' END) AS outcome FROM r UNION ALL SELECT 'eval_overlap' FROM h UNION ALL SELECT 'no_text' FROM documents WHERE text IS NULL)
SELECT outcome, count(*) AS rows FROM f GROUP BY 1""",
)
def curated_corpus(t):
    """Documents by outcome: held-out overlap, then length and duplicates, then the split of the key's hash. Texts are normalized once;
    what follows works on their keys."""
    hits = D.overlapping(t.documents, "doc_id", "text", t.evaluation).withColumn("hit", F.lit(True))
    norm = X.normalized(F.col("text"))
    keyed = written(t.documents.select("doc_id", F.sha2(norm, 256).alias("k"), X.token_count(F.col("text")).alias("n"), P.split_of(norm).alias("split"), F.col("text").isNull().alias("empty")), "keyed")
    rows = keyed.join(hits, "doc_id", "left").withColumn("outcome", F.when(F.col("empty"), "no_text").when(F.col("hit"), "eval_overlap"))
    judged = S.first_accepted(rows.where("outcome is null").select("doc_id", "k", "n", "split"), "k", "doc_id", F.col("n").between(6, 4000), "length", "duplicate", "outcome")
    kept = judged.select(F.coalesce("outcome", "split").alias("outcome"))
    return rows.where("outcome is not null").select("outcome").unionByName(kept).groupBy("outcome").agg(F.count("*").alias("rows"))


@query("s6_1_reason_funnel", "SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN source IS NULL THEN 'no_source' WHEN split = 'test' THEN 'test_row' END AS reason FROM sft) GROUP BY 1")
def reason_funnel(t):
    return G.funnel(G.waterfall(t.sft, [("no_source", F.col("source").isNotNull()), ("test_row", F.col("split") != "test")]))


@query("s9_4_bare_code")
def bare_code(t):
    return t.samples.select("sample_id", "received_at", C.bare_code_udf(F.col("raw_completion")).alias("code"))


@query("s9_17_token_count", f"SELECT row_id, len({W.format('prompt')}) AS tokens, prompt_tokens AS stated FROM sft WHERE prompt IS NOT NULL")
def token_count(t):
    return t.sft.where("prompt is not null").select("row_id", X.token_count(F.col("prompt")).cast("long").alias("tokens"), F.col("prompt_tokens").alias("stated"))


_BOTH = f"list_concat({W.format('prompt')}, {W.format('completion')}) = {W.format('prompt || completion')}"


@query("s9_18_token_boundary", f"SELECT row_id, {_BOTH} AS clean FROM sft WHERE prompt IS NOT NULL AND completion IS NOT NULL")
def token_boundary(t):
    return t.sft.where("prompt is not null and completion is not null").select("row_id", X.splits_cleanly(F.col("prompt"), F.col("completion")).alias("clean"))
