"""Queries over literal cases, for operators that SQL can't express on the tables: the SQL is the table of the rows expected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as X
from ..operators import select as S
from .registry import query


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return str(value)


def cases(name: str, schema: str, inputs: list[tuple], result: Callable[[DataFrame], DataFrame], columns: str, expected: list[tuple]) -> None:
    """Registers a query that applies `result` to literal inputs, and its expected rows as SQL."""
    rows = ", ".join("(" + ", ".join(map(_sql, row)) + ")" for row in expected)
    query(name, f"SELECT * FROM (VALUES {rows}) AS v({columns})")(lambda t: result(t.spark.createDataFrame(inputs, schema)))


def numbered(rows: list) -> list[tuple]:
    return [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]


def each(name: str, column: str, kinds: str, rows: list[tuple], result: Callable[[DataFrame], Column]) -> None:
    """cases() for one result per row of the inputs: rows hold the inputs and, last, what is expected."""
    cases(name, f"i int, {kinds}", numbered([r[:-1] for r in rows]), lambda df: df.select("i", result(df).alias(column)), f"i, {column}", numbered([r[-1] for r in rows]))


GOOD = "def total(xs):\n    return sum(xs)\n"
BAD = "def total(xs):\n    return sum(xs[:-1])\n"
MARKERS = ("optimization_level",)

each(
    "s10_1c_parses_cases", "kind", "code string",
    [("def f(): pass", "function"), ("async def f(): pass", "parses"), ("x = 1", "parses"), ("x = (", "neither"), (None, "neither"), ("class A:\n    def f(self): pass", "parses"), ("", "parses")],
    lambda df: F.when(C.has_function_udf(F.col("code")), "function").when(C.parses_udf(F.col("code")), "parses").otherwise("neither"),
)
each(
    "s10_2c_pair_reason_cases", "reason", "question string, chosen string, rejected string",
    [
        ("Return the sum of a list.", GOOD, BAD, None),
        ("Read from standard input.", GOOD, BAD, "program_or_embedded_code_prompt"),
        ("Fix ```x```", GOOD, BAD, "program_or_embedded_code_prompt"),
        ("Tune Optimization_Level.", GOOD, BAD, "engineering_prompt"),
        ("Sum", "def total(self): return 1", BAD, "method_needs_class_context"),
        ("Sum", GOOD + "total([1])\n", BAD, "not_function_module"),
        ("Sum", "x = (", BAD, "not_function_module"),
        ("Sum", None, BAD, "not_function_module"),
        ("Sum", "import pandas\n" + GOOD, BAD, "external_dependency"),
        ("Sum", "from . import x\n" + GOOD, BAD, "external_dependency"),
        ("Sum", "import math, heapq\n" + GOOD, BAD, None),
        ("Sum", GOOD, "def total(xs): return int(input())", "io_or_dynamic_execution"),
        ("Sum", GOOD, "def total(xs): ...", "placeholder"),
        ("Sum", GOOD, "def total(xs): return xs.reshape(1)", "array_or_tensor_dependency"),
        ("Sum", GOOD, "def other(xs): return 0", "different_function_interface"),
        ("Sum", GOOD, GOOD + "# other\n", "same_code_ast"),
        ("Sum", GOOD, "def total(xs):\n    def g():\n        nonlocal n\n    return g", "invalid_scope"),
        ("Sum", GOOD, "def total(xs): return expected + sum(xs)", "undefined_global"),
        ("Sum", "def total(xs):\n    def inner(x): return x + len(xs)\n    return sum(inner(x) for x in xs)", BAD, None),
        ("Sum", GOOD, "def total(xs):\n    return [y for y in xs if (z := y)] and z", None),
        ("Sum", GOOD, "def total(xs):\n    class A:\n        n = 1\n        def g(self): return n\n    return A", "undefined_global"),
    ],
    lambda df: C.udf(lambda q, a, b: C.pair_reason(q, a, b, MARKERS), "string")(F.col("question"), F.col("chosen"), F.col("rejected")),
)
cases(
    "s10_5c_implementation_cases", "i int, code string",
    numbered(['def f(x):\n    "doc"\n    return x\n', "def f( x ):  # note\n  return x", "def f(x): return 1", "def f(x):\n    return (1)", "x = (", None]),
    lambda df: S.first_seen(df.select("i", C.implementation_key_udf(F.col("code")).alias("k")).where("k is not null"), "k", "i").select("i", "is_first"),
    "i, is_first", [(0, True), (1, False), (2, True), (3, False)],
)
_MUTATED = "def f(xs):\n    # 0 < 1\n    return xs[0] < 1 or \"0 < 1\"\n"
cases(
    "s10_6c_mutation_cases", "i int, code string",
    numbered([_MUTATED, "def f(n):\n    while n > 0:\n        n -= 1\n    return n\n", "x = (", None, "def f(a=0):\n    return f'{a + 1}'"]),
    lambda df: df.select("i", "code", F.explode(C.mutations_udf(F.col("code"), F.lit(42), 9)).alias("m")).select("i", "m.line", "m.column", "m.old", "m.new", (F.length("m.code") - F.length(F.col("code"))).alias("longer")),
    'i, line, "column", old, new, longer', [(0, 3, 14, "0", "1", 0), (0, 3, 17, "<", "<=", 1), (0, 3, 19, "1", "0", 0), (0, 3, 21, "or", "and", 1)],
)
_TWO = "def f(a, b): return a + b\n"
each(
    "s10_8c_example_test_cases", "test", "prompt string, reference string, given string, result string",
    [
        ("Return f(a, b).", _TWO, "3 5", "8", "assert f(3, 5) == 8"),
        ("Return f(a, b) in any order.", _TWO, "3 5", "8", None),
        ("f", _TWO, "a = 1\nb = [2]", "8", "assert f(1, [2]) == 8"),
        ("f", _TWO, "b = 2; a = 1; c = 3", "'x'", "assert f(1, 2) == 'x'"),
        ("f", _TWO, "a = 1", "8", None),
        ("f", _TWO, "a = g(1)\nb = 2", "8", None),
        ("f", _TWO, "g(1)", "8", None),
        ("f", _TWO, "1 2 3", "8", None),
        ("f", _TWO, "3 5", "eight", None),
        ("f", "def f(x): return x", "[1, 2]", "'a'", "assert f([1, 2]) == 'a'"),
        ("use g", "def f(x): return x\ndef g(y): return y\n", "1", "2", "assert g(1) == 2"),
        ("f", "def f(): return 1", "1", "1", None),
        (None, _TWO, "1", "1", None),
    ],
    lambda df: C.example_test_udf(F.col("prompt"), F.col("reference"), F.col("given"), F.col("result")),
)
_SAMPLES = "\n**Sample Input 1:**\n```\n3 5\n```\n**Sample Output 1:**\n```\n8\n```\n"
each(
    "s10_9c_expanded_cases", "found", "prompt string, reference string",
    [("f" + _SAMPLES, _TWO, "2|1|assert f(3, 5) == 8"), ("f" + _SAMPLES.replace("3 5", "g()"), _TWO, "2|0|"), ("f", _TWO, "0|0|")],
    lambda df: (lambda e: F.concat_ws("|", F.size(e).cast("string"), F.size(t := C.example_tests_udf(F.col("prompt"), F.col("reference"), e)).cast("string"), F.array_join(t, ";")))(F.concat(X.numbered_examples(F.col("prompt")), X.numbered_examples(F.col("prompt")))),
)
each(
    "s10_10c_probe_cases", "probe", "code string",
    [("import re\ndef f(x):\n    y = x\n    return y\n", "import re\n\ndef f(x):\n    return None"), ("async def f(): pass", "async def f():\n    pass"), ("(", None), (None, None)],
    lambda df: C.null_probe_udf(F.col("code")),
)
_HELPED = "def helper(x): return x\ndef f(x): return helper(x)\n"
each(
    "s10_12c_entry_cases", "entry", "reference string, tests array<string>",
    [
        (_HELPED, ["assert f(1) == 1", "assert f(2) == 2"], "f|true"), (_HELPED, ["assert f(1) == 1", "assert helper(1) == 1"], "none|true"),
        (_HELPED, ["assert 1", "assert f(1)"], "f|false"), (_HELPED, ["assert len([]) == 0"], "none|false"), (_HELPED, None, "none|true"), (None, ["assert f(1)"], "none|false"),
    ],
    lambda df: F.concat_ws("|", F.coalesce(C.public_entry_udf(F.col("reference"), F.col("tests")), F.lit("none")), C.tests_call_function_udf(F.col("reference"), F.col("tests")).cast("string")),
)
cases(
    "s10_13c_static_cases", "i int, solution string, entry string",
    numbered([("async def f(): pass\nassert True\n", "f"), ("def g(): pass", "f"), ("x = 1\ndef f(:\n", "f"), (None, "f")]),
    lambda df: df.select("i", C.static_facts_udf(F.col("solution"), F.col("entry")).alias("s")).select("i", "s.message", "s.line", "s.text", "s.entry_defined", "s.top_level_asserts"),
    "i, message, line, text, entry_defined, top_level_asserts", [(0, None, None, None, True, 1), (1, None, None, None, False, 0), (2, "invalid syntax", 2, "def f(:\n", None, None), (3, None, None, None, False, 0)],
)
each(
    "s10_14c_first_function_cases", "name", "code string",
    [("x = 1\ndef b(): pass\ndef a(): pass", "b"), ("async def c(): pass\ndef d(): pass", "d"), ("class A:\n    def e(self): pass", None), ("(", None), (None, None)],
    lambda df: C.first_function_udf(F.col("code")),
)
each(
    "s4_8c_checked_tests_cases", "tests", "tests array<string>",
    [
        ([f"assert f({i}) == {i}" for i in range(5)], "assert f(0) == 0;assert f(1) == 1;assert f(2) == 2;assert f(3) == 3;assert f(4) == 4"),
        ([*(f"assert f({i})" for i in range(5)), "assert f( 0 )"], "assert f(0);assert f(1);assert f(2);assert f(3);assert f(4)"),
        ([f"assert f({i})" for i in range(4)], ""), ([*(f"assert f({i})" for i in range(5)), "f(1)"], ""), ([f"assert f({i})" for i in range(21)], ""), (None, ""), ([], ""),
    ],
    lambda df: F.array_join(C.checked_tests_udf(F.col("tests")), ";"),
)
each(
    "s9_4c_bare_code_cases", "code", "answer string",
    [
        ("\ufeff```python\ndef f(x):\n    return x\n```", "def f(x):\n    return x\n"), ("  def f(x): return x  \n\n", "def f(x): return x\n"),
        ("Here it is:\ndef f(x): return x", None), ("```\ndef f(x): return x\n```", None), ("async def f(): pass", None), (None, None),
    ],
    lambda df: C.bare_code_udf(F.col("answer")),
)
each(
    "s9_11c_diff_cases", "diff", "a string, b string",
    [("x\ny\n", "x\nz\n", "--- before\n+++ after\n@@ -1,2 +1,2 @@\n x\n-y\n+z"), ("same", "same", ""), (None, "n", "--- before\n+++ after\n@@ -0,0 +1 @@\n+n"), (None, None, "")],
    lambda df: C.unified_diff_udf(F.col("a"), F.col("b")),
)
each(
    "s3_6c_names_cases", "names", "code string",
    [("def b():\n    def A_b(): pass\nclass C:\n    def c1(self): pass", "ab,b,c1"), ("async def q(): pass", ""), ("(", ""), (None, "")],
    lambda df: F.array_join(F.transform(C.function_names_udf(F.col("code")), X.plain_name), ","),
)
