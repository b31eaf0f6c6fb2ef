import random

import pytest
from pyspark.sql import functions as F

from loomcurate.operators import audit as A
from loomcurate.operators import decontaminate as D
from loomcurate.operators import evaluate as E
from loomcurate.operators import gates as G
from loomcurate.operators import sampling as P
from loomcurate.operators import select as S


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def test_statuses_and_waterfall(spark):
    cases = [(None, False), ("not json", False), ("[]", False), ('["pass",null]', False), ('["pass","fail"]', False), ('["pass"]', True)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, s string")
    assert [r[1] for r in rows(df.select("i", G.all_tests_passed(F.lit(1.0), F.col("s")).alias("ok")))] == [c[1] for c in cases]
    got = G.waterfall(df, [("early", F.col("i") > 1), ("late", F.col("s") == '["pass"]')])
    assert [r[1] for r in rows(got, "i", "reason")] == ["early", "early", "late", "late", "late", None]
    with pytest.raises(Exception, match="must not be null"):
        df.select(G.well_formed(F.col("s"), F.lit("```python\nx\n```"))).collect()
    assert G.require_rows(df.withColumn("split", F.lit("a")), "split", {"a": 6}).first().rows == 6
    with pytest.raises(Exception, match="too few rows"):
        G.require_rows(df.withColumn("split", F.lit("a")), "split", {"b": 1}).collect()


@pytest.mark.parametrize("most", [200_000, 1])
def test_overlap_by_grams(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST_GRAMS", most)
    tasks = spark.createDataFrame([("Write a Python function to reverse every word in a sentence.",), (" ".join(f"w{i}" for i in range(13)),), ("one two three four five",), (None,)], "prompt string")
    grams = rows(D.held_out_grams(tasks))
    assert [g[0] for g in grams] == [11, 12, 12]
    texts = [(1, "x write a python function to reverse every word in a sentence y"), (2, "Implement a binary search tree insertion"), (3, " ".join(f"W{i}" for i in range(1, 13))), (4, "one two three four five"), (5, None), (6, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    assert rows(D.overlapping(df, "id", "text", tasks)) == [(1,), (3,)]
    assert rows(D.overlapping(df, "id", "text", tasks.limit(0))) == []


def test_join_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "k int, v string")
    assert rows(D.key_violations(a, "k")) == [(2, 2)]
    assert rows(D.join_violations(a, b, "k", "v")) == [(2,), (2,)]
    assert rows(D.coverage_gaps({"a": a, "b": b.where("k > 1")}, "k")) == [(1, ["b"])]
    left = spark.createDataFrame([("t", 1), ("t", 2)], "s string, l int")
    right = spark.createDataFrame([("t", 10), ("t", 20)], "s string, r int")
    assert rows(D.zipped(left, right, "s", "l", "r"), "l", "r") == [(1, 10), (2, 20)]
    with pytest.raises(Exception, match="differ in length"):
        D.zipped(left, right.limit(1), "s", "l", "r").collect()


def test_first_accepted_is_not_shadowed(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", True), (4, "a", False), (5, None, False)], "ord int, k string, long boolean")
    got = S.first_accepted(df, "k", "ord", ~F.col("long"), "too_long", "duplicate")
    assert [r[1] for r in rows(got, "ord", "reason")] == ["too_long", None, "duplicate", "duplicate", None]


def greedy_by_hand(data, caps):
    seen = [set(), set()]
    used, kept = {}, set()
    for o, p, c, f in sorted(data):
        if p not in seen[0] and c not in seen[1] and used.get(f, 0) < caps:
            seen[0].add(p)
            seen[1].add(c)
            used[f] = used.get(f, 0) + 1
            kept.add(o)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_the_sequential_pass(spark, seed):
    r = random.Random(seed)
    data = [(i, f"p{r.randrange(30)}", f"c{r.randrange(30)}", f"f{r.randrange(4)}") for i in range(80)]
    df = spark.createDataFrame(data, "ord long, p string, c string, f string")
    assert {x[0] for x in rows(S.greedy(df, "ord", ["p", "c"], {"f": 5}).where("accepted"), "ord")} == greedy_by_hand(data, 5)
    reasons = dict(rows(S.greedy_reasons(df, "ord", {"p": "dup_p", "c": "dup_c"}, {"f": (5, "cap")}), "ord", "reason"))
    assert {o for o, x in reasons.items() if x is None} == greedy_by_hand(data, 5) and set(reasons.values()) <= {None, "dup_p", "dup_c", "cap"}


def test_greedy_decides_long_chains(spark):
    """Each row waits for the one before: a round decides one row."""
    data = [(i, f"p{(i + 1) // 2}", f"c{i // 2}", "f") for i in range(600)]
    df = spark.createDataFrame(data, "ord long, p string, c string, f string")
    assert {x[0] for x in rows(S.greedy(df, "ord", ["p", "c"]).where("accepted"), "ord")} == greedy_by_hand(data, 600)


@pytest.mark.parametrize("seed", range(2))
def test_greedy_in_order(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "ROUNDS", seed)
    monkeypatch.setattr(S, "IN_ORDER", 25)
    r = random.Random(seed)
    data = [(i, f"p{r.randrange(60)}", f"c{(i + 1) // 2}", f"f{r.randrange(4)}") for i in range(150)]
    df = spark.createDataFrame(r.sample(data, 150), "ord long, p string, c string, f string")
    assert {x[0] for x in rows(S.greedy(df, "ord", ["p", "c"], {"f": 8}).where("accepted"), "ord")} == greedy_by_hand(data, 8)
    with pytest.raises(ValueError, match="unique and not null"):
        S.greedy(df.withColumn("ord", F.lit(None).cast("long")), "ord", ["p"])


def test_split_selection_and_caps(spark):
    data = [(i, "valid" if i % 3 == 0 else "train", f"id{i % 11}", f"e{i % 4}") for i in range(40)]
    df = spark.createDataFrame(data, "ord long, split string, id string, entry string")
    with pytest.raises(ValueError, match="train has"):
        S.split_selection(df, "split", "ord", ["id"], "entry", {"valid": 3, "train": 50}, cap=2)
    got = S.split_selection(df, "split", "ord", ["id"], "entry", {"valid": 3, "train": 50}, cap=2, allow_short=True)
    picked = rows(got, "split", "ord", "id", "entry")
    valid = [x for x in picked if x[0] == "valid"]
    train = [x for x in picked if x[0] == "train"]
    assert [x[1] for x in valid] == [0, 3, 6] and not {x[3] for x in valid} & {x[3] for x in train}
    assert len({x[2] for x in picked}) == len(picked)
    capped = rows(S.capped(df, "entry", ["ord"], 2), "ord")
    assert [x[0] for x in capped] == list(range(8))
    best = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.9), ("a", 2, 0.9)], "k string, i int, s double")
    assert rows(S.best_candidate(best, "k", "s", "i"), "i") == [(0,)]


def test_samples_and_orders(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    places = rows(P.shuffled(df, "k", 1), "position")
    assert sorted(p[0] for p in places) == list(range(1, 1001))
    assert rows(P.sample(df, "k", 5, 1)) == rows(P.sample(df.repartition(7), "k", 5, 1))
    with pytest.raises(Exception, match="fewer than"):
        P.sample(df, "k", 1001, 1).collect()
    e = P.epochs(spark.range(5).withColumnRenamed("id", "k"), "k", 42, 3).collect()
    for n in range(3):
        assert sorted(r.k for r in e if r.epoch == n) == list(range(5)) and sorted(r.position for r in e if r.epoch == n) == list(range(5))
    n = P.ranked(df.withColumn("g", F.col("k") % 2), "g", "k").collect()
    assert all(r.row_number == r.k // 2 + 1 for r in n)
    assert P.dataset_seed(42, "a") == spark.range(1).select(P.dataset_seed_column(42, F.lit("a"))).first()[0]


def test_evaluation(spark):
    a = spark.createDataFrame([("s", "t1", "pass", "pass"), ("s", "t2", "fail", "pass"), ("s", "t3", None, "pass")], "suite string, task_id string, base_status string, plus_status string")
    got = E.pass_at_1(a, ["suite"]).first()
    assert (got.passed, got.base_passed, got.total) == (1, 1, 3)
    with pytest.raises(Exception, match="several attempts"):
        E.pass_at_1(a.union(a), ["suite"]).collect()
    b = a.withColumn("base_status", F.when(F.col("task_id") == "t1", "fail").otherwise("pass"))
    assert rows(E.transition_counts(E.paired(a, b, ["suite", "task_id"]))) == [("s", 1, 2, 0, 0)]
    with pytest.raises(Exception, match="no scores"):
        E.by_stage(E.pass_at_1(a.withColumn("stage", F.lit("base")), ["stage", "suite"]), ["base", "dpo"], ["s"]).collect()


def test_audits(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, True, [0.5, 1.0]), (2, 0.5, 1.0, False, [1.0, 1.0]), (3, None, None, True, [])], "i int, r double, c double, t boolean, m array<double>")
    got = df.select("i", A.quality_reasons(F.col("r"), F.col("c"), F.col("t"), F.col("m")).alias("reasons"))
    assert [len(r[1]) for r in rows(got)] == [0, 4, 1]
    with pytest.raises(Exception, match="finite number"):
        df.select(A.checked_score(F.col("r"))).collect()
    codes = spark.createDataFrame([("x", ["a"]), ("y", None)], "code string, tests array<string>")
    assert rows(A.score_with(codes, lambda c, t: [len(x) / 2 for x in t], "code", "tests"), "code", "score") == [("x", 0.5), ("y", 0.0)]

    def broken(codes, tests):
        raise OSError("no sandbox")

    with pytest.raises(Exception, match="no sandbox"):
        A.score_with(codes, broken, "code", "tests").collect()
    text = "def f(x):\n    return x + 1\n"
    ok = A.replays(F.lit(text), F.lit(text.replace("+", "-")), F.lit(2), F.lit(13), F.lit("+"), F.lit("-"))
    wrong = A.replays(F.lit(text), F.lit(text), F.lit(2), F.lit(13), F.lit("+"), F.lit("-"))
    assert spark.range(1).select(ok, wrong).first()[:] == (True, False)
    steps = spark.createDataFrame([("r", 1, 0.2), ("r", 2, 0.5), ("r", 3, 0.5), ("r", 4, 0.1)], "run string, step int, v double")
    assert A.checkpoint_of_best(steps, "run", "step", "v").first().step == 2 and A.checkpoint_of_least(steps, "run", "step", "v").first().step == 4
    assert [r.improved for r in A.best_so_far(steps, "step", "v", "run").orderBy("step").collect()] == [True, True, False, False]


def test_large_limits_are_cut_by_counting(spark, monkeypatch):
    monkeypatch.setattr(P, "TOP", 10)
    r = random.Random(1)
    values = [r.randrange(10**6) for _ in range(900)] + [5] * 300
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long")
    for limit in (0, 10, 11, 250, 333, 1199, 1200, 5000):
        got = P.first_rows(df, ["v", "i"], limit).collect()
        assert sorted((x.v, x.i) for x in got) == sorted((v, i) for i, v in enumerate(values))[:limit]
    whole = {x.i for x in P.sample(df, "i", 400, 7).collect()}
    monkeypatch.setattr(P, "TOP", 1000)
    assert whole == {x.i for x in P.sample(df, "i", 400, 7).collect()} and len(whole) == 400
    with pytest.raises(ValueError, match="fewer than"):
        P.sample(df, "i", 1201, 7).collect()


def test_ranks_of_texts_and_in_groups_of_null(spark):
    r = random.Random(2)
    data = [(r.choice(["a", None]), f"id-{r.randrange(10**9)}-ü{i}") for i in range(500)]
    got = {(x.g, x.t): x.row_number for x in P.ranked(spark.createDataFrame(data, "g string, t string"), "g", "t").collect()}
    for g in ("a", None):
        assert [got[g, t] for t in sorted((t for h, t in data if h == g), key=str.encode)] == list(range(1, 1 + sum(h == g for h, _ in data)))


def test_spread_is_exact(spark):
    import statistics

    r = random.Random(3)
    data = [(g, r.choice([1, 2, r.randrange(1000)])) for g in ("a", "b", None) for _ in range(r.randrange(40, 400))] + [("one", 7), ("two", 1), ("two", 4), ("none", None)]
    got = {x.g: (x.least, x["median"], x.greatest) for x in A.spread(spark.createDataFrame(data, "g string, v int"), ["g"], "v").collect()}
    of = lambda g: [v for h, v in data if h == g]
    assert got == {g: (min(of(g)), statistics.median(of(g)), max(of(g))) for g in ("a", "b", None, "one", "two")}
    assert A.spread(spark.createDataFrame([], "g string, v int"), ["g"], "v").count() == 0


def test_records_of_runs(spark):
    counts = spark.createDataFrame([("a", "s", 1, 2), ("b", "s", 2, 2), ("c", "s", 0, 2)], "run string, suite string, passed long, total long")
    configs = spark.createDataFrame([("a", "a", "h", None, False, 512), ("b", "x", "old", 10, True, None)], "run string, stage string, eval_sha256 string, limit_per_suite int, do_sample boolean, max_new_tokens int")
    summaries = spark.createDataFrame([("a", "a", "s", "h", 1, 2, 0.5), ("b", "b", "s", None, 1, 2, 0.5), ("b", "b", "other", "h", 0, 0, None)], "run string, stage string, suite string, eval_sha256 string, passed long, total long, pass_at_1 double")
    got = {(x.run, x.check): x.violations for x in E.record_checks(configs, summaries, counts, "h", "run").collect()}
    assert {k for k, n in got.items() if k[0] == "a" and n} == set() and len(got) == 27
    assert {k[1]: n for k, n in got.items() if k[0] == "b" and n} == {"config_stage": 1, "config_evaluation": 1, "limited": 1, "decoding": 1, "summary_evaluation": 1, "passed": 2, "total": 1, "pass_at_1": 2}
    assert {k[1] for k, n in got.items() if k[0] == "c" and n} == {"config_stage", "config_evaluation", "limited", "decoding", "summary_stage", "summary_evaluation", "passed", "total", "pass_at_1"}
    same = spark.createDataFrame([("r", "t1", "x"), ("r", "t1", None), ("r", "t2", "y")], "run string, task_id string, solution string")
    other = same.withColumn("solution", F.when(F.col("solution") == "x", "z").otherwise(F.col("solution")))
    tasks = spark.createDataFrame([("t1",), ("t2",)], "task_id string")
    checks = lambda judged: {x.check: x.violations for x in E.run_checks(same, judged, tasks, "run").collect()}
    assert checks(same.orderBy(F.rand()))["other_solution"] == 0 and checks(other)["other_solution"] == 1 and checks(same)["several_attempts"] == 1
    assert {(x.run, x.rows) for x in E.comparison_violations(same.select("run"), "run", ["r", "gone"]).collect()} == {("r", 3), ("gone", 0)}


def test_samples_are_executed_again(spark):
    df = spark.createDataFrame([(i, "c", ["t"] * (i % 3), 0.5 if i else None) for i in range(30)], "k long, code string, tests array<string>, stated double")
    got = A.reexecuted(df, "k", 1, 30, lambda codes, tests: [len(t) / 2 for t in tests], "code", "tests", "stated").collect()
    assert all(r.matched == (r.k % 3 == 1 and r.k > 0) for r in got) and len(got) == 30
    flat = A.flattened(df, "k", "tests").withColumn("n", F.col("at") + 1)
    assert {r.k: r["values"] for r in A.regrouped(flat, "k", "n").collect()} == {i: list(range(1, i % 3 + 1)) for i in range(30) if i % 3}
