import os

import pytest

import __spark_entry__ as entry
from compare import same
from loomcurate.llm import queries

FOLDER = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert name in entry.queries() and same(spark, FOLDER, name) == ""


def test_packing_of_the_tables_is_whole(spark):
    """Every document once, its pieces in order without gaps; no sequence over its capacity."""
    rows = queries.QUERIES["p4_sequences"](spark, FOLDER).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    pieces: dict = {}
    used: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.n_tokens))
        if r.sequence_id is not None:
            used[r.sequence_id] = used.get(r.sequence_id, 0) + r.n_tokens
    assert set(pieces) == ids and max(used.values()) <= 2048
    for own in pieces.values():
        own.sort()
        assert [p for p, *_ in own] == list(range(len(own))) and [s for _, s, _ in own] == [sum(n for *_, n in own[:i]) for i in range(len(own))]


def test_edited_passages_include_the_exact_ones(spark):
    found = {n: {tuple(r) for r in queries.QUERIES[n](spark, FOLDER).collect()} for n in ("p5_found", "p5_edited")}
    assert found["p5_found"] <= found["p5_edited"]


def test_redacted_texts_hold_none_of_the_places_found(spark):
    texts = {r.doc_id: r.text for r in queries.QUERIES["p6_redacted"](spark, FOLDER).collect()}
    found = queries.QUERIES["p6_found"](spark, FOLDER).collect()
    assert found and {r.pii_type for r in found} <= {"email", "phone", "id_number", "street_address", "person_name"}
    assert sum(r.pii_text in texts[r.doc_id] for r in found if r.pii_type in ("email", "id_number")) == 0
