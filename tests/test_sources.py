import pytest
from pyspark.sql import functions as F

from loomcurate.operators.gates import waterfall
from loomcurate.sources import reports as R
from loomcurate.sources import tables as T
from loomcurate.streaming import funnel as S


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("a", None, ["ü"]), ("b", 1, None)], "id string, n int, x array<string>")
    path = str(tmp_path / "out")
    T.write_jsonl(df, path)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert '"n":null' in text and "ü" in text
    assert sorted(map(tuple, T.read_jsonl(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="(?i)already exists"):
        T.write_jsonl(df, path)
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n\nno json\n')
    with pytest.raises(Exception):
        T.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    (tmp_path / "blank.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert T.read_jsonl(spark, str(tmp_path / "blank.jsonl"), "id string").count() == 2
    with pytest.raises(Exception, match="repeated or missing"):
        T.indexed(df.union(df), "id").collect()


def test_judge_documents(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"eval": {"T/1": [{"task_id": "T/1", "solution": "x", "base_status": "pass", "plus_status": "fail"}]}, "other": 1}')
    from loomcurate.operators.evaluate import attempts_of

    got = attempts_of(T.read_judge(spark, str(tmp_path / "e.json"))).first()
    assert (got.task_id, got.attempt, got.base_status, got.plus_status) == ("T/1", 0, "pass", "fail")


def test_locks_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert T.fingerprint(df).first() == T.fingerprint(df.repartition(5).select("v", "k")).first()
    assert T.fingerprint(df).first() != T.fingerprint(df.withColumn("k", F.col("k") + 1)).first()
    assert T.fingerprint(df.limit(0)).first().rows == 0
    lock = tmp_path / "lock.json"
    T.write_lock(T.lock_of({"t": df}, evaluation="e1"), lock)
    with pytest.raises(FileExistsError):
        T.write_lock({}, lock)
    assert T.locked(df, lock, "t", {"evaluation": "e1"}) is df
    for change in (lambda: T.locked(df.limit(1), lock, "t"), lambda: T.locked(df, lock, "t", {"evaluation": "e2"})):
        with pytest.raises(T.DataError):
            change()
    first, second = (T.new_version(df, str(tmp_path / "data")) for _ in range(2))
    assert first.endswith("v1") and second.endswith("v2") and spark.read.parquet(first).count() == 2
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert T.file_sha256(tmp_path / "f.bin") == T.binary_sha256(spark, str(tmp_path / "f.bin")).first().sha256


def test_reports(spark, tmp_path):
    cases = spark.createDataFrame([("T/1", "lost", "</pre><script>alert(1)</script>", None)], "task_id string, transition string, before string, after string")
    page = R.case_report(cases, "Cases")
    assert page.count("<script>") == 1 and "&lt;/pre&gt;&lt;script&gt;" in page
    assert R.markdown_table(cases.select("task_id", F.lit("a|b\nc").alias("x"))) == "| task_id | x |\n| --- | --- |\n| T/1 | a\\|b c |\n"
    (tmp_path / "a.md").write_text("[b](b.md) [w](https://x.org) [c](#c) [a](a.md)")
    assert R.broken_links(tmp_path, ["a.md"]) == [("a.md", "b.md")]
    R.write_new("x", tmp_path / "r")
    with pytest.raises(FileExistsError):
        R.write_new("x", tmp_path / "r")


def test_streaming_gates(spark, tmp_path):
    df = spark.sql("SELECT id, timestamp'2026-01-01' + make_interval(0, 0, 0, 0, 0, cast(id AS int)) AS at FROM range(10)")
    df.union(df.limit(3)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    gates = [("odd", F.col("id") % 2 == 0)]
    q = S.log_to(S.gated_stream(stream, gates, "id", "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.json(str(tmp_path / "out"))
    assert got.count() == 10 and got.where("reason = 'odd'").count() == waterfall(df, gates).where("reason = 'odd'").count()
    assert S.reasons_by_window(waterfall(df, gates), "at").agg(F.sum("rows")).first()[0] == 10


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from loomcurate import session

    for master, fine in (("local", True), ("local[8]", True), ("local[*, 2]", True), ("local-cluster[3,2,1024]", False), ("yarn", False), ("spark://host:7077", False)):
        settings = {}
        one = SimpleNamespace(conf=SimpleNamespace(get=settings.get, set=settings.__setitem__), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))
        if fine:
            assert session.shared_folder(one) == settings["spark.checkpoint.dir"]
        else:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                session.shared_folder(one)
            settings["spark.checkpoint.dir"] = "hdfs:///shared"
            assert session.shared_folder(one) == "hdfs:///shared"


def test_written_tables_can_be_dropped(spark):
    from pathlib import Path

    from loomcurate import session

    table = session.written(spark.range(5), "five")
    folder = Path(table.inputFiles()[0].removeprefix("file:").replace("//", "")).parent
    assert table.count() == 5 and folder.exists()
    session.drop_written(table)
    assert not folder.exists()


def test_rebuilding_starts_from_the_archive(spark, tmp_path):
    root = str(tmp_path / "versions")
    first = spark.createDataFrame([(1, True), (2, False)], "id long, ok boolean")
    T.new_version(first, root)
    stated = T.fingerprint(first).first().asDict()
    build = lambda df: df.where("ok").withColumn("id", F.col("id") + 10)
    paths = [T.rebuilt(spark, root, stated, build) for _ in range(2)]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["v2", "v3"] and all(spark.read.parquet(p).first().id == 11 for p in paths)
    with pytest.raises(T.DataError, match="no version"):
        T.archived(spark, root, stated | {"rows": 3})


def test_links_and_bindings(spark):
    text = "[a](b.md) [c](./d/../b.md#x) [e](../up.md) [f](#own) [g](https://x.example) [h](/docs/b.md) [i](no%20way.md) <a href='mailto:x@y.z'> [j](100%.md)"
    pages = spark.createDataFrame([("docs/a.md", text), ("docs/n.md", None)], "path string, text string")
    files = spark.createDataFrame([("docs/a.md",), ("docs/b.md",), ("docs/no way.md",)], "path string")
    assert sorted(r.target for r in T.link_violations(pages, files).collect()) == ["../up.md", "100%.md"]
    stated = spark.createDataFrame([("audit", "source", "1"), ("audit", "scorer", "2"), ("review", "gone", "3")], "name string, key string, value string")
    found = spark.createDataFrame([("now", "source", "1"), ("now", "scorer", "9")], "name string, key string, value string")
    assert sorted(tuple(r) for r in T.binding_violations(stated, found).collect()) == [("audit", "scorer", "2", "9"), ("review", "gone", "3", None)]
    with pytest.raises(T.DataError, match="audit is bound to another scorer"):
        T.require_bindings(stated, found)
    T.require_bindings(stated.limit(0), found)


def test_locks_on_the_cluster(spark, tmp_path):
    path = f"file://{tmp_path}/deep/x.lock.json"
    T.write_lock({"tables": {}, "ü": 1}, path, spark)
    assert T.read_lock(path, spark) == {"tables": {}, "ü": 1} and [f.name for f in (tmp_path / "deep").iterdir() if f.name[0] != "."] == ["x.lock.json"]
    with pytest.raises(FileExistsError):
        T.write_lock({}, path, spark)
