import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomcurate.functions import code as C
from loomcurate.functions import text as X
from loomcurate.functions import training as M

GOOD = "def total(xs):\n    return sum(xs)\n"
BAD = "def total(xs):\n    return sum(xs[:-1])\n"


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_words_fold_like_python(spark):
    texts = ["Für Straße_1!", "ﬁne ſtop K", "", None, "ẞ \U0001d400 İ", "a-b__c9"]
    got = values(spark, [(t,) for t in texts], "t string", X.words(F.col("t")))
    import re

    assert [g[0] for g in got] == [None if t is None else re.findall("[a-z0-9_]+", t.casefold()) for t in texts]


def test_fences_and_examples(spark):
    rows = [("```python\nx = 1\n```",), ("say ```python\nx\n```",), ("```py\na\n```\nb\n```",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", X.fenced_code(F.col("t")))] == ["x = 1", None, "a\n```\nb", None]
    sample = "**Sample Input {}:**\n```\n1\n```\n**Sample Output {}:**\n```python\n2\n```\n"
    rows = [(sample.format(1, 1) + sample.format(2, 3),), (None,), ("",)]
    got = values(spark, rows, "t string", X.numbered_examples(F.col("t")))
    assert [None if r[0] is None else [tuple(p) for p in r[0]] for r in got] == [[("1", "2")], None, []]


def test_strip_prefix_escape_names_lists(spark):
    rows = [("  \n a\tb\x1f\n",), ("",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", X.strip(F.col("t")))] == ["a\tb", "", None]
    assert one(spark, X.unwrap_prompt(X.wrap_prompt(F.lit("q\n")))) == "q\n"
    assert one(spark, X.html_escape(F.lit("</pre><script>\"'&"))) == "&lt;/pre&gt;&lt;script&gt;&quot;&#x27;&amp;"
    assert one(spark, X.markdown_cell(F.lit("a|b\r\nc"))) == "a\\|b c"
    rows = [("call f.x(1)", "f.x"), ("call fax", "f.x"), ("foobar", "foo"), (None, "a")]
    assert [r[0] for r in values(spark, rows, "t string, n string", X.mentions(F.col("t"), F.col("n")))] == [True, False, False, None]
    rows = [('["a","b"]',), ('["a",1]',), ("[]",), ("{}",), ("no",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", X.string_list(F.col("t")))] == [["a", "b"], None, [], None, None, None]
    assert one(spark, X.links(F.lit('[a](b.md) <img src="c.png">'))) == ["b.md", "c.png"]
    assert one(spark, X.plain_name(F.lit("hex_Key"))) == "hexkey"


def test_ngrams(spark):
    rows = [(list("abc"),), (list("ab"),), (None,)]
    assert [r[0] for r in values(spark, rows, "t array<string>", X.ngrams(F.col("t"), 3))] == [["a b c"], [], []]


def test_pair_reasons():
    cases = [
        ("Return the sum of a list.", GOOD, BAD, None),
        ("Read from standard input.", GOOD, BAD, "program_or_embedded_code_prompt"),
        ("Tune optimization_level.", GOOD, BAD, "engineering_prompt"),
        ("Sum", GOOD, GOOD + "# other\n", "same_code_ast"),
        ("Sum", GOOD, "def other(xs): return 0", "different_function_interface"),
        ("Sum", "import pandas\n" + GOOD, BAD, "external_dependency"),
        ("Sum", "from . import x\n" + GOOD, BAD, "external_dependency"),
        ("Sum", GOOD, "def total(xs): return int(input())", "io_or_dynamic_execution"),
        ("Sum", GOOD, "def total(xs): return expected + sum(xs)", "undefined_global"),
        ("Sum", "def total(xs):\n    def inner(x): return x + len(xs)\n    return sum(inner(x) for x in xs)", BAD, None),
        ("Sum", "def total(self): return 1", BAD, "method_needs_class_context"),
        ("Sum", GOOD + "total([1])\n", BAD, "not_function_module"),
        ("Sum", GOOD, "def total(xs): ...", "placeholder"),
        ("Sum", GOOD, "def total(xs): return xs.reshape(1)", "array_or_tensor_dependency"),
        (None, None, BAD, "not_function_module"),
    ]
    for question, chosen, rejected, reason in cases:
        assert C.pair_reason(question, chosen, rejected, ("optimization_level",)) == reason, (question, rejected)


def test_bare_code_and_names():
    assert C.bare_code("﻿```python\ndef f(x):\n    return x\n```") == "def f(x):\n    return x\n"
    assert C.bare_code("Here it is:\ndef f(x): return x") is None
    assert C.bare_code("async def f(): pass") is None and C.bare_code(None) is None
    assert C.function_names("def b():\n    def a(): pass\n") == ["a", "b"] and C.function_names("(" * 500) == []


def test_implementation_key_ignores_docstrings_and_layout():
    assert C.implementation_key('def f(x):\n    "doc"\n    return x\n') == C.implementation_key("def f( x ):  # note\n  return x")
    assert C.implementation_key("def f(x): return 1") != C.implementation_key("def f(x): return 2")
    assert "return None" in C.constant_probe("def f(x): return x", None)


def test_mutations_touch_code_tokens_only():
    code = 'def total(xs):\n    """0 + 1 >= 0"""\n    # 0 + 1 >= 0\n    return sum(xs) + 1\n'
    made = C.mutations(code, 42, 6)
    assert made and made == C.mutations(code, 42, 6)
    assert all(m["line"] == 4 and '"""0 + 1 >= 0"""' in m["code"] and "# 0 + 1 >= 0" in m["code"] for m in made)
    assert C.mutations("def f(n):\n    while n > 0:\n        n -= 1\n    return n\n", 42, 6) == []
    assert C.mutations(None, 1, 1) == [] and C.mutations("x = (", 1, 1) == []


def test_mutations_leave_texts_headers_and_longer_operators():
    code = 'def f(a=0):\n    s = f"{a + 1}" + "é < 0" ; é1 = 10 ** 2 // 3\n    return a <= 1 and s is not None and é1 -0x1\n'
    made = {(m["line"], m["column"], m["old"]) for m in C.mutations(code, 1, 99)}
    assert made == {(2, 19, "+"), (3, 13, "<="), (3, 16, "1"), (3, 18, "and"), (3, 36, "and"), (3, 43, "-")}
    for m in C.mutations(code, 1, 99):
        line = code.split("\n")[m["line"] - 1]
        assert m["code"].split("\n")[m["line"] - 1] == line[: m["column"]] + m["new"] + line[m["column"] + len(m["old"]) :]


SCOPES = [
    ("def f(x):\n    return [y for y in x if (z := y)] and z", None),
    ("def f(x):\n    class A:\n        n = 1\n        def g(self): return n\n    return A", "undefined_global"),
    ("def f(x):\n    class A:\n        n = 1\n        m = [n for _ in x]\n    return A", "undefined_global"),
    ("def f(x):\n    n = 0\n    def g():\n        nonlocal n\n        n += 1\n        return n\n    return g", None),
    ("def f(x):\n    def g():\n        nonlocal n\n    return g", "invalid_scope"),
    ("def f(x):\n    global n\n    n = x\n    return n", "undefined_global"),
    ("n = 0\ndef f(x):\n    global n\n    n = x\n    return n", None),
    ("def f(x):\n    try:\n        import os.path as p, re\n    except OSError as e:\n        return e, p, re\n    return lambda q, *r, s=x, **t: (q, r, s, t)", None),
    ("def f(x):\n    match x:\n        case [a, *b] | {'k': a, **b}:\n            return a, b\n        case str() as c:\n            return c", None),
    ("from __future__ import annotations\ndef f(x: Unknown) -> Other:\n    return x", None),
    ("def f(x: Unknown):\n    return x", "undefined_global"),
    ("def f(x):\n    return {k: v for k in x for v in k if w}", "undefined_global"),
]


@pytest.mark.parametrize("code,fault", SCOPES)
def test_names_are_resolved_through_scopes(code, fault):
    assert C._scope_fault(code, C.parse(code)) == fault


def test_example_tests():
    reference = "def f(a, b): return a + b\n"
    assert C.example_test("Return f(a, b).", reference, "3 5", "8") == "assert f(3, 5) == 8"
    assert C.example_test("Return any order.", reference, "3 5", "8") is None
    assert C.example_test("f", reference, "a = 1\nb = [2]", "8") == "assert f(1, [2]) == 8"
    assert C.example_test("f", "def f(x): return x", "[1, 2]", "'a'") == "assert f([1, 2]) == 'a'"
    assert C.example_test("f", reference, "g(1)", "8") is None and C.example_test(None, reference, "1", "1") is None


def test_checked_tests_and_entries():
    tests = [f"assert f({i}) == {i}" for i in range(5)]
    assert C.checked_tests(tests) == tests
    assert C.checked_tests([*tests, "assert f( 0 )==0"]) == tests
    assert C.checked_tests(tests[:4]) == [] and C.checked_tests([*tests, "f(1)"]) == [] and C.checked_tests(None) == []
    reference = "def helper(x): return x\ndef f(x): return helper(x)\n"
    assert C.public_entry(reference, tests) == "f" and C.public_entry(reference, [*tests, "assert helper(1) == 1"]) is None
    assert C.tests_call_function(reference, tests) and not C.tests_call_function(reference, ["assert 1"])
    facts = C.static_facts("async def f(): pass\nassert True\n", "f")
    assert facts["entry_defined"] and facts["top_level_asserts"] == 1
    assert C.static_facts("def f(:", "f")["line"] == 1


def test_code_udfs_take_nulls(spark):
    df = spark.createDataFrame([("def f(x):\n    return x + 1\n", "f"), ("(", None), (None, "g")], "c string, n string")
    got = df.select(C.parses_udf("c").alias("p"), C.first_function_udf("c").alias("f"), C.static_facts_udf("c", "n").alias("s"), F.size(C.mutations_udf(F.col("c"), F.lit(3))).alias("m")).collect()
    assert [(r.p, r.f, r.m) for r in got] == [(True, "f", 2), (False, None, 0), (False, None, 0)]
    assert got[0].s.entry_defined and got[1].s.message and got[1].s.entry_defined is None


def test_training_goldens(spark):
    a = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    g = one(spark, M.gae(a(0, 1), a(0, 0), lam=1.0))
    assert (g.advantages, g.returns) == ([1, 1], [1, 1])
    p = one(spark, M.ppo_loss(a(0, 0), a(0, 0), a(0, 0), a(0, 0), a(1, 1), a(1, 1)))
    assert (p.policy, p.value, p.total) == pytest.approx((-1, 0.5, -0.75))
    assert one(spark, M.dpo_loss(F.lit(-2.0), F.lit(-2.0), F.lit(-2.0), F.lit(-2.0))) == pytest.approx(math.log(2))
    for z, v in ((0, math.log(2)), (800, 0), (-800, 800)):
        assert one(spark, M.neg_log_sigmoid(F.lit(float(z)))) == pytest.approx(v)
    assert one(spark, M.grpo_loss(a(1, 1), a(0, 0), F.lit(1.0))) == pytest.approx(-1.2)
    assert one(spark, M.clip_fraction(a(1, 0.1), a(0, 0))) == pytest.approx(0.5)
    assert one(spark, M.whiten(a(3))) == [3] and sum(one(spark, M.whiten(a(1, 2, 3)))) == pytest.approx(0, abs=1e-6)
    assert one(spark, M.shaped_rewards(a(1, 1), a(0, 0), F.lit(100.0))) == pytest.approx([-0.02, 4.98])
    logits = F.array(a(0, 0, 0, 0, 0), a(0, 0, 10, 0, 0), a(0, 0, 0, 10, 0), a(0, 0, 0, 0, 0))
    got = one(spark, M.action_logprobs(logits, F.array(*map(F.lit, range(4))), F.lit(2)))
    assert len(got) == 2 and all(-0.001 < v < 0 for v in got)
    assert one(spark, M.mean(F.array().cast("array<double>"))) is None
    assert one(spark, M.hit_length_limit(F.array(F.lit(1), F.lit(2)), 2, 3)) and not one(spark, M.hit_length_limit(F.array(F.lit(1), F.lit(3)), 2, 3))


def test_group_advantages(spark):
    rows = [("a", r) for r in (1.0, 0.0, 0.0, 0.0)] + [("b", 0.5)] * 4
    got = M.group_advantages(spark.createDataFrame(rows, "g string, r double"), "g", "r").collect()
    assert sorted(round(r.advantage, 4) for r in got if r.g == "a") == [-0.5774] * 3 + [1.7321]
    assert all(r.advantage == 0 for r in got if r.g == "b")
    for bad in ([("a", 1.0)] * 3, [("a", 1.5)] * 4, [("a", float("nan"))] * 4, [("a", None)] * 4):
        with pytest.raises(Exception, match="finite rewards"):
            M.group_advantages(spark.createDataFrame(bad, "g string, r double"), "g", "r").collect()


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(-3, 3), st.floats(-3, 3)), min_size=1, max_size=6))
def test_gae_equals_the_recurrence(spark, pairs):
    rewards, states = zip(*pairs)
    want, following, nxt = [], 0.0, 0.0
    for r, v in reversed(pairs):
        following = r + nxt - v + 0.95 * following
        nxt = v
        want.append(following)
    got = spark.createDataFrame([(list(rewards), list(states))], "r array<double>, v array<double>").select(M.gae(F.col("r"), F.col("v"))["advantages"].alias("a")).first().a
    assert got == pytest.approx(want[::-1], abs=1e-9)


def test_losses_equal_a_reference_on_random_cases(spark):
    """40 random cases: log-probabilities of answers from logits, and the preference loss of four of them, worked out in numpy."""
    import numpy as np

    r = np.random.default_rng(42)
    cases, want = [], []
    for case in range(40):
        prompt, answer = 1 + case % 7, 1 + case % 11
        logits, ids = r.normal(size=(prompt + answer, 19)), r.integers(0, 19, prompt + answer)
        log_p = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        four = r.normal(size=4)
        want.append((sum(log_p[i - 1, ids[i]] for i in range(prompt, prompt + answer)), np.logaddexp(0, -0.1 * ((four[0] - four[2]) - (four[1] - four[3])))))
        cases.append((case, logits.tolist(), ids.tolist(), prompt, *four.tolist()))
    df = spark.createDataFrame(cases, "i int, logits array<array<double>>, ids array<int>, prompt int, a double, b double, c double, d double")
    total = M.total(M.action_logprobs(F.col("logits"), F.col("ids"), F.col("prompt"), 1.0))
    got = df.select("i", total.alias("t"), M.dpo_loss(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("l")).orderBy("i").collect()
    assert [x.t for x in got] == pytest.approx([w[0] for w in want], abs=1e-9)
    assert [x.l for x in got] == pytest.approx([w[1] for w in want], abs=1e-9)
