import hashlib
import json
import os

import pytest

import __spark_entry__ as entry
from compare import same
from loomcurate.plans import registry

FOLDER = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    if name in entry.oracle_sql():
        assert same(spark, FOLDER, name) == ""
    else:
        df = entry.queries()[name](spark, FOLDER)
        assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_mutations_are_as_many_as_in_the_export(spark, tmp_path):
    code = "def f(a, b):\n    x = a + b\n    y = a - b\n    if x < y and x > 0:\n        return x * y\n    return True\n"
    spark.createDataFrame([(1, "s", code)], "row_id long, source_id string, completion string").write.parquet(f"{tmp_path}/sft.parquet")
    assert entry.queries()["s10_6_mutations"](spark, str(tmp_path)).count() == 6
    assert [(r.mutations, r.replayed) for r in entry.queries()["s10_7_replay"](spark, str(tmp_path)).collect()] == [(6, 6)]


def test_fingerprint_values_equal_brute_force(spark, tmp_path):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    plain = lambda v: "{}" if v is None else json.dumps({"v": v}, separators=(",", ":"), ensure_ascii=False)
    tables = {"evaluation": [(1, "a"), (2, None)], "grpo": [(1, "a"), (1, "a"), (None, 'q"ö')], "rl": [], "sft": [(1, "b"), (2, None)]}
    for name, data in tables.items():
        spark.createDataFrame(data, "z long, b string").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    want = {}
    for name, data in tables.items():
        hashes = [sha("\x1f".join((plain(b), plain(z)))) for z, b in data]
        want[name] = (len(data), sha(",".join(str(sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes)) for i in range(4))))
    got = {r["name"]: (r["rows"], r.fingerprint) for r in entry.queries()["s1_9b_fingerprint_values"](spark, str(tmp_path)).collect()}
    assert got == want and len({f for _, f in got.values()}) == 4


def test_entry(spark):
    assert entry.entry(spark).count() > 0
