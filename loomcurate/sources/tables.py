"""Reading, writing and checking data sets: JSON lines, judge documents, fingerprints, locks and versions."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import links

ATTEMPTS = "eval map<string, array<struct<task_id:string, solution:string, base_status:string, plus_status:string>>>"


class DataError(ValueError):
    """Data that isn't what its lock or its reader says it is."""


def read_shard(spark: SparkSession, path: str, order: str = "ordinal") -> DataFrame:
    """A Parquet table with the place of each row in its file as `order`."""
    return spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias(order))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, skip_blank: bool = True) -> DataFrame:
    """JSON lines in a stated schema. A line that isn't JSON of that shape fails the job; blank lines are skipped, or fail."""
    lines = spark.read.text(path)
    if skip_blank:
        lines = lines.where(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "value")
    whole = F.when(F.col("r").isNull(), F.raise_error(F.lit("a line is not a JSON object")).cast(parsed.schema["r"].dataType)).otherwise(F.col("r"))
    return parsed.select(whole.alias("r")).select("r.*")


def indexed(df: DataFrame, key: str) -> DataFrame:
    """df, which raises while running if a key repeats or is null."""
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    bad = F.raise_error(F.concat(F.lit("repeated or missing key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return df.join(counts.select(F.col(key).alias("__k"), "__n"), F.col(key).eqNullSafe(F.col("__k"))).where(F.when((F.col("__n") == 1) & F.col(key).isNotNull(), True).otherwise(bad.cast("boolean"))).drop("__k", "__n")


def read_judge(spark: SparkSession, path: str) -> DataFrame:
    """Judge documents, whole files of JSON, with their attempts by task."""
    return spark.read.schema(ATTEMPTS).json(path, multiLine=True, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str, split: str | None = None) -> None:
    """JSON lines in UTF-8 with null fields kept; refuses to overwrite. Spark's committer publishes the files at once."""
    w = df.write.mode("errorifexists").option("ignoreNullFields", "false")
    (w.partitionBy(split) if split else w).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds records to a log of JSON lines."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def binary_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of all files of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): the same for the same rows in any order and partitioning; columns count in order of their names."""
    columns = [F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("null")) for c in sorted(df.columns)]
    h = F.sha2(F.concat_ws("\x1f", *columns), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
    return df.agg(F.count("*").alias("rows"), *(part(i).alias(f"p{i}") for i in range(4))).select("rows", F.sha2(F.concat_ws(",", *(F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(4))), 256).alias("fingerprint"))


def lock_of(tables: dict[str, DataFrame], **facts: object) -> dict:
    """Counts and fingerprints of the tables with further facts, for write_lock()."""
    return {"tables": {n: fingerprint(df).first().asDict() for n, df in tables.items()}, **facts}


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of the JVM."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def write_lock(lock: dict, path: str | Path, spark: SparkSession | None = None) -> None:
    """Writes a lock by way of a temporary file beside it; an existing lock is kept and refused. With a session the path is one of
    the cluster's file systems, else one of this machine."""
    text = json.dumps(lock, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    if spark is not None:
        files, there = _hadoop(spark, str(path))
        if files.exists(there):
            raise FileExistsError(str(path))
        _, beside = _hadoop(spark, f"{path}.{os.getpid()}")
        out = files.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not files.rename(beside, there):
            raise FileExistsError(str(path))
        return
    path = Path(path)
    if path.exists():
        raise FileExistsError(path)
    temporary = path.with_name(f".{path.name}.{os.getpid()}")
    temporary.write_text(text, encoding="utf-8")
    os.replace(temporary, path)


def read_lock(path: str | Path, spark: SparkSession | None = None) -> dict:
    """A lock that write_lock() made."""
    if spark is not None:
        return json.loads(spark.read.text(str(path), wholetext=True).first()["value"])
    return json.loads(Path(path).read_text(encoding="utf-8"))


def locked(df: DataFrame, lock: str | Path | dict, name: str, bindings: dict[str, object] | None = None) -> DataFrame:
    """df after its fingerprint was found to equal the lock's; bindings are facts the lock must hold, such as the evaluation's hash."""
    stated = lock if isinstance(lock, dict) else read_lock(lock)
    for k, v in (bindings or {}).items():
        if stated.get(k) != v:
            raise DataError(f"{name}: {k} is {stated.get(k)!r} in the lock, not {v!r}")
    if stated["tables"].get(name) != (found := fingerprint(df).first().asDict()):
        raise DataError(f"{name} doesn't match its lock: {found}")
    return df


def integrity(tables: dict[str, DataFrame], lock: dict) -> DataFrame:
    """(name, rows, locked_rows, violations): counts against a lock."""
    out = None
    for name, df in tables.items():
        stated = lock["tables"][name]["rows"]
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(stated).alias("locked_rows"), F.when(F.col("rows") == stated, 0).otherwise(1).alias("violations"))
        out = part if out is None else out.unionByName(part)
    return out


def _versions(spark: SparkSession, root: str) -> list[int]:
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(base) if s.getPath().getName().startswith("v")) if fs.exists(base) else []


def new_version(df: DataFrame, root: str) -> str:
    """Writes the next numbered version under root and returns its path; earlier versions stay as the archive."""
    path = f"{root.rstrip('/')}/v{max(_versions(df.sparkSession, root), default=0) + 1}"
    df.write.mode("errorifexists").parquet(path)
    return path


def archived(spark: SparkSession, root: str, stated: dict) -> DataFrame:
    """The version under root with the stated rows and fingerprint (as in a lock), the current one or one of the archive; raises if none has."""
    for number in reversed(_versions(spark, root)):
        df = spark.read.parquet(f"{root.rstrip('/')}/v{number}")
        if fingerprint(df).first().asDict() == stated:
            return df
    raise DataError(f"no version under {root} is the stated input")


def rebuilt(spark: SparkSession, root: str, stated: dict, build: Callable[[DataFrame], DataFrame]) -> str:
    """Builds a version again from its stated input rather than from its own last output, and returns the path of the result."""
    return new_version(build(archived(spark, root, stated)), root)


def binding_violations(stated: DataFrame, found: DataFrame) -> DataFrame:
    """(name, key, stated, found) where a record states another value than is found, or one that isn't there.

    Both sides have name, key and value (strings): what the audit `name` says of `key`, such as its source, scorer or script, and
    the fingerprint that this has now. Values that nothing states are no violation.
    """
    now = found.select("key", F.col("value").alias("found"))
    joined = stated.select("name", "key", F.col("value").alias("stated")).join(now, "key", "left")
    return joined.where(F.col("found").isNull() | ~F.col("stated").eqNullSafe(F.col("found"))).select("name", "key", "stated", "found")


def require_bindings(stated: DataFrame, found: DataFrame) -> None:
    """Raises where binding_violations() finds any; names some of them."""
    if bad := binding_violations(stated, found).limit(20).collect():
        raise DataError("; ".join(f"{r['name']} is bound to another {r['key']}" for r in bad))


def link_violations(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target) of local links that lead to no file. pages: path, text; files: path.

    Targets are those of text.links(); addresses with a scheme are skipped, anchors alone lead to their own page, and relative
    targets are resolved against the page's folder. Targets above the root lead nowhere.
    """
    each = pages.select("path", F.explode(links(F.col("text"))).alias("target")).where(~F.col("target").rlike("(?i)^(?:[a-z][a-z0-9+.-]*:|//)"))
    file = F.url_decode(F.regexp_replace(F.split_part("target", F.lit("#"), F.lit(1)), "%(?![0-9A-Fa-f]{2})", "%25"))
    folder = F.regexp_replace("path", r"[^/]*\z", "")
    parts = F.filter(F.split(F.concat(F.when(file.startswith("/"), "").otherwise(folder), file), "/"), lambda p: ~p.isin("", "."))
    up = lambda done, p: F.when(p != "..", F.concat(done, F.array(p))).when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(F.array(F.lit("..")))
    resolved = F.when(file == "", F.col("path")).otherwise(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))
    return each.withColumn("__file", resolved).join(files.select(F.col("path").alias("__file")).distinct(), "__file", "left_anti").select("path", "target").distinct()


def repository_checks(tables: dict[str, DataFrame], lock: dict, evaluation_hash: str, runs: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """(part, name, check, violations): one report over data, results and documents.

    Data: rows and fingerprints against the lock, and the evaluation that the lock names. Results: the rows (run, check, violations) of
    evaluate.run_checks() and record_checks(). Documents: local links without a file, per page. Only violations above 0 have rows.
    """
    spark = pages.sparkSession
    facts = [("data", "lock", "evaluation", int(lock.get("evaluation") != evaluation_hash))]
    for name, df in tables.items():
        stated, now = lock["tables"].get(name, {}), fingerprint(df).first()
        facts += [("data", name, "rows", int(stated.get("rows") != now["rows"])), ("data", name, "fingerprint", int(stated.get("fingerprint") != now["fingerprint"]))]
    facts += [("data", name, "missing", 1) for name in lock["tables"] if name not in tables]
    data = spark.createDataFrame(facts, "part string, name string, check string, violations long")
    results = runs.select(F.lit("results").alias("part"), F.col(runs.columns[0]).cast("string").alias("name"), "check", F.col("violations").cast("long").alias("violations"))
    documents = link_violations(pages, files).groupBy(F.col("path").alias("name")).agg(F.count("*").alias("violations"))
    documents = documents.select(F.lit("documents").alias("part"), "name", F.lit("link").alias("check"), "violations")
    return data.unionByName(results).unionByName(documents).where("violations > 0")


def frozen_tasks(suites: dict[str, DataFrame]) -> DataFrame:
    """One manifest of evaluation tasks: (suite, task_id, prompt, entry_point). Tests and answers are left behind."""
    out = None
    for suite, df in suites.items():
        part = df.select(F.lit(suite).alias("suite"), "task_id", "prompt", "entry_point")
        out = part if out is None else out.unionByName(part)
    return out
