import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcurate.llm import components as K
from loomcurate.llm import neardup as N
from loomcurate.llm import overlap as O
from loomcurate.llm import records as R
from loomcurate.llm import shingles as S
from loomcurate.llm import simhash as H
from loomcurate.llm import superminhash as M


def grams(text):
    w = re.findall("[a-z0-9_]+", (text or "").casefold())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def edited(r, words, changes):
    words = list(words)
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, families=12, versions=5, loners=60):
    """Families of edited versions, loners, copies, and odd texts."""
    r = random.Random(seed)
    text = lambda: [f"w{r.randrange(4000)}" for _ in range(r.randrange(40, 90))]
    out = []
    for _ in range(families):
        base = text()
        out += [edited(r, base, r.randrange(0, 5)) for _ in range(versions)]
    out += [" ".join(text()) for _ in range(loners)]
    out += r.sample(out, 10) + [None, "", "  ", "two words", "one two three", "One, two; THREE!", "a " * 20000]
    r.shuffle(out)
    return out


def test_shingle_sets_equal_plain_sets():
    docs = [S.words(t) for t in corpus(1) if t and len(S.words(t)) >= 3]
    values, offsets = S.shingle_sets(docs, 3)
    assert [int(n) for n in np.diff(offsets)] == [len(grams(" ".join(d))) for d in docs]
    assert S.shingle_sets([], 3)[1].tolist() == [0] and S.shingle_sets([["a"]], 3)[1].tolist() == [0, 0]


def test_fingerprints_follow_similarity():
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    p = H.projections(*S.shingle_sets([base, edited(r, base, 3).split(), [f"v{i}" for i in range(120)]], 3))
    f = H.fingerprints(p)
    near, far = (int(np.bitwise_count((f[0] ^ f[i]).view(np.uint64)).sum()) for i in (1, 2))
    assert near < 250 and 420 < far < 600
    codes, offsets = H.probe_codes(p[:1], 14, 50, 0.75)
    assert len(codes) == 50 == offsets[-1] and len(set(codes.tolist())) == 50
    assert {c >> 14 for c in H.segment_codes(p, 14)[0].tolist()} == set(range(H.TABLES))


def test_superminhash_estimates_without_bias():
    r = random.Random(3)
    got, want = [], []
    for _ in range(60):
        a = [f"w{r.randrange(10**6)}" for _ in range(100)]
        b = edited(r, a, r.randrange(1, 12)).split()
        values, offsets = S.shingle_sets([a, b], 3)
        sig = M.signatures(values, offsets, 128)
        got.append((sig[0] == sig[1]).mean())
        want.append(jaccard(grams(" ".join(a)), grams(" ".join(b))))
    errors = np.array(got) - np.array(want)
    assert abs(errors.mean()) < 0.02 and errors.std() < 0.06


def test_superminhash_in_parts(monkeypatch):
    values, offsets = S.shingle_sets([[f"w{i}" for i in range(n)] for n in (3, 500, 4, 77)], 3)
    for slots in (64, 300):
        monkeypatch.setattr(M, "PART_BYTES", 1 << 25)
        whole = M.signatures(values, offsets, slots)
        monkeypatch.setattr(M, "PART_BYTES", 50 * slots)
        assert (M.signatures(values, offsets, slots) == whole).all()


def test_plans_hold_their_recall():
    for n in (10, 10**6, 10**8, 10**10):
        rows, bands = N.bands_for(n, 0.6)
        assert (1 - 0.6**rows) ** bands <= N.MISS and rows * bands < 5000
    assert O.code_plan(0)[0] == 13 and O.code_plan(10**9)[0] > 14


@pytest.mark.parametrize("seed,crowd", [(4, 64), (5, 64), (4, 1), (16, 2)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(N, "CROWD", crowd)
    texts = corpus(seed)
    data = [(i, t, "ab"[i % 7 == 0], 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "row_id long, text string, scope string, k int")
    parent = {i: i for i, *_ in data}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a, s, _), (j, b, t, _) in itertools.combinations(data, 2):
        if s == t and jaccard(grams(a), grams(b)) >= 0.6:
            parent[top(i)] = top(j)
    want = {(i, j) for (i, a, s, _), (j, b, t, _) in itertools.combinations(data, 2) if grams(a) and grams(b) and s == t and top(i) == top(j)}
    got = [tuple(r) for r in N.group_pairs(N.near_groups(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([], "row_id long, text string, scope string")
    assert N.near_groups(df).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, "x y", None)], "row_id long, text string, scope string")
    assert [r.group_key for r in N.near_groups(odd).collect()] == [None, None, None]


def test_a_hot_family_costs_no_more_pairs_than_members(spark):
    """A third of the rows are versions of one text: the first comparison takes each member once per band, not each pair."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    data = [(i, edited(r, base, 2), "a") for i in range(150)] + [(1000 + i, " ".join(f"v{i}_{j}" for j in range(50)), "a") for i in range(300)]
    groups = N.near_groups(spark.createDataFrame(data, "row_id long, text string, scope string")).collect()
    assert len({g.group_key for g in groups if g.row_id < 1000}) == 1 and len({g.group_key for g in groups}) == 301


def test_prefixes_bring_all_similar_sets_together(spark):
    r = random.Random(17)
    base = [r.randrange(2**31) for _ in range(40)]
    sets = {k: sorted(set(r.sample(base, r.randrange(1, 40)) + [r.randrange(2**31) for _ in range(r.randrange(12))])) for k in range(150)}
    sets[150] = [5]
    rows = spark.createDataFrame(list(sets.items()), "k long, shingles array<int>")
    texts = spark.createDataFrame([(k, k, 0, 0) for k in sets], "k long, c long, s0 long, s1 long")
    bands: dict = {}
    for row in N.prefixes(texts, rows, 0.6).collect():
        bands.setdefault(row.k, set()).add(row.band)
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6]
    assert len(pairs) > 50 and all(bands[a] & bands[b] for a, b in pairs) and set(bands) == set(sets)


def test_boilerplate_of_10_000_texts_costs_no_pairs(spark, monkeypatch):
    """10,000 unlinked texts share half of their words, and so their buckets, and some of them have a partner of their own."""
    r = random.Random(18)
    shared = " ".join(f"b{i}" for i in range(40))
    own = [[f"u{i}_{j}" for j in range(60)] for i in range(10_000)]
    data = [(i, shared + " " + " ".join(w), "a") for i, w in enumerate(own)] + [(20_000 + i, shared + " " + edited(r, own[i], 2), "a") for i in range(50)]
    compared = []
    between = N._between
    monkeypatch.setattr(N, "_between", lambda members, floor: compared.append(members.groupBy("band").count().selectExpr("sum(count * (count - 1) / 2) AS n").first().n) or between(members, floor))
    groups = {g.row_id: g.group_key for g in N.near_groups(spark.createDataFrame(data, "row_id long, text string, scope string").repartition(8)).collect()}
    assert all(groups[i] == groups[20_000 + i] for i in range(50)) and len(set(groups.values())) == 10_000
    assert compared[0] < 1_000_000  # of 50 million pairs


def test_components(spark):
    r = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    parent = {x: x for pair in links for x in pair}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {row.node: row.component for row in K.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in linked}
    assert K.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [8, 9])
def test_overlaps_equal_brute_force(spark, seed):
    r = random.Random(seed)
    texts = corpus(seed, families=15, versions=6)
    names = [None, "", "fooBar", "foo_bar", "x", "common"]
    data = [(i, t, r.choice(names), r.choice(["train", "train", "valid", "test", "other", None]), 5) for i, t in enumerate(texts)]
    plain = lambda n: re.sub("[^a-z0-9]", "", (n or "").casefold())
    want = set()
    for (i, a, n, s, _), (j, b, m, t, _) in itertools.combinations(data, 2):
        if {s, t} in ({"train", "valid"}, {"train", "test"}):
            like = jaccard(grams(a), grams(b))
            if like >= 0.6 or (plain(n) and plain(n) == plain(m) and like >= 0.35):
                want.add((i, j) if t == "train" else (j, i))
    df = spark.createDataFrame(data, "row_id long, text string, name string, split string, held_out int")
    got = [(x.held_out_row, x.train_row) for x in O.overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {x.row_id: (x.class_id, x.links) for x in O.row_links(df).collect()}
    known = {i: " ".join(re.findall("[a-z0-9_]+", (t or "").casefold())) for i, t, _, s, _ in data if s in ("train", "valid", "test")}
    alike = lambda i: [i] if known[i].count(" ") < 2 else [j for j in known if known[j] == known[i]]
    assert links == {i: (min(alike(i)), sum(i in pair for pair in want)) for i in known}
    counts = {(x.split, x.held_out): (x.pairs, x.rows) for x in O.overlap_counts(df, ["split", "held_out"]).collect()}
    held = {i: s for i, _, _, s, _ in data}
    assert counts == {(s, 5): (sum(held[i] == s for i, _ in want), len({i for i, _ in want if held[i] == s})) for s in ("valid", "test") if any(held[i] == s for i, _ in want)}


def test_overlaps_of_nothing(spark):
    none = spark.createDataFrame([], "row_id long, text string, name string, split string")
    assert O.overlaps(none).count() == 0 and O.row_links(none).count() == 0 and O.overlap_counts(none, ["split"]).count() == 0


def test_codes_of_both_sides_agree(spark):
    """What the training side stores as columns is what the held-out side looks up."""
    r = random.Random(13)
    rows = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(30)), "n", side) for i in range(20) for side in ("train", "valid")]
    texts = O.Texts(spark.createDataFrame([(i, t, n, s) for i, t, n, s in rows], "row_id long, text string, name string, split string"))
    docs = [S.words(t) for _, t, _, s in rows if s == "train"]
    p = H.projections(*S.shingle_sets(docs, 3))
    (bits, tables, _), (name_bits, name_tables, _) = texts.plan, texts.name_plan
    want = {S.content_key(d): {2 * int(c) for c in a} | {int((np.int64(c) << 40) ^ O._name_hash("n") | 1) for c in b} for d, a, b in zip(docs, H.segment_codes(p, bits, tables), H.segment_codes(p, name_bits, name_tables))}
    got: dict = {}
    for row in O._stored(texts).collect():
        got.setdefault(row.k, set()).add(row.code)
    assert got == want


def test_copies_are_counted_by_their_classes(spark):
    """A third of all rows are copies of one text on both sides: classes, not row pairs, are joined."""
    text = " ".join(f"w{i}" for i in range(40))
    hot = spark.range(20_000).select(F.col("id").alias("row_id"), F.lit(text).alias("text"), F.lit("solve").alias("name"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    cold = spark.range(500).select((F.col("id") + 10**6).alias("row_id"), F.concat_ws(" ", *(F.concat(F.lit(f"v{i}_"), F.col("id").cast("string")) for i in range(9))).alias("text"), F.lit("solve").alias("name"), F.lit("train").alias("split"))
    got = O.overlap_counts(hot.unionByName(cold), ["split"]).collect()
    assert [tuple(r) for r in got] == [("test", 5000 * 15_000, 5000)]


def test_common_names_are_split_by_codes(spark, monkeypatch):
    plan = O.name_plan(2**16 + 1)
    monkeypatch.setattr(O, "name_plan", lambda rows: plan)
    r = random.Random(10)
    base = [f"w{i}" for i in range(60)]
    data = [(i, edited(r, base, 10), "solve", "train" if i % 3 else "valid") for i in range(60)]
    want = {(i, j) for (i, a, _, s), (j, b, _, t) in itertools.permutations(data, 2) if s == "valid" and t == "train" and jaccard(grams(a), grams(b)) >= 0.35}
    got = {(x.held_out_row, x.train_row) for x in O.overlaps(spark.createDataFrame(data, "row_id long, text string, name string, split string")).collect()}
    assert len(got - want) == 0 and len(want - got) <= 0.02 * len(want)


def found_by_codes(size, similarity, pairs, bits, probes, tables=H.TABLES, seed=11):
    """Share of pairs of sets of `size` shingles, exactly at the similarity, of which one looks up a code of the other."""
    r = np.random.default_rng(seed)
    shared = 2 * similarity / (1 + similarity) * size
    assert abs(shared - round(shared)) < 1e-9
    sets = [[np.concatenate([s, r.integers(0, 2**31, size - len(s))]) for _ in range(2)] for s in (r.integers(0, 2**31, round(shared)) for _ in range(pairs))]
    p = H.projections(np.concatenate([x for pair in sets for x in pair]), np.arange(2 * pairs + 1) * size)
    codes, offsets = H.probe_codes(p[::2], bits, probes, O.cosine_of(similarity), tables)
    assert offsets.tolist() == [probes * i for i in range(pairs + 1)]
    return np.mean([np.isin(own, codes[a:b]).any() for own, a, b in zip(H.segment_codes(p[1::2], bits, tables), offsets, offsets[1:])])


@pytest.mark.parametrize("rows", [10**6, 10**7, 10**8, 10**9])
@pytest.mark.parametrize("size", [8, 60])
def test_code_plans_are_carried_out_and_hold_their_recall(rows, size):
    bits, tables, probes = O.code_plan(rows)
    assert found_by_codes(size, 0.6, 600, bits, probes, tables) >= (0.98 if rows == 10**6 else 0.99)


@pytest.mark.parametrize("rows", [0, (1 << 16) + 1, (1 << 20) + 1])
@pytest.mark.parametrize("size", [27, 108])
def test_name_plans_hold_their_recall(rows, size):
    bits, tables, probes = O.name_plan(rows)
    assert found_by_codes(size, 0.35, 1000, bits, probes, tables) >= 0.993


def test_too_many_look_ups_fail():
    p = H.projections(*S.shingle_sets([[f"w{i}" for i in range(50)]], 3))
    with pytest.raises(ValueError, match="candidates"):
        H.probe_codes(p, 4, 32 * 16 + 1, 0.75)
    codes, _ = H.probe_codes(np.repeat(p, 200, 0), 22, 16384, 0.75)
    assert len(set(codes[:16384].tolist())) == 16384 and (np.sort(codes.reshape(200, -1), 1) == np.sort(codes[:16384])).all()


def test_overlaps_by_the_plan_of_many_rows(spark, monkeypatch):
    plan, names = O.code_plan(10**9), O.name_plan(10**9)
    monkeypatch.setattr(O, "code_plan", lambda rows: plan)
    monkeypatch.setattr(O, "name_plan", lambda rows: names)
    monkeypatch.setattr(O, "_BATCH_CODES", 100_000)
    r = random.Random(12)
    bases = [[f"w{r.randrange(4000)}" for _ in range(40)] for _ in range(30)]
    data = [(i, edited(r, bases[i % 30], r.randrange(4)), None, "train" if i < 90 else "valid") for i in range(120)]
    want = {(i, j) for (i, a, _, s), (j, b, _, t) in itertools.permutations(data, 2) if s == "valid" and t == "train" and jaccard(grams(a), grams(b)) >= 0.6}
    got = {(x.held_out_row, x.train_row) for x in O.overlaps(spark.createDataFrame(data, "row_id long, text string, name string, split string")).collect()}
    assert got == want and want


PLAIN = "Sum the list.\n\n**Input:**\nA list.\n\n**Output:**\nThe sum.\n"
RECORDS = [
    (1, PLAIN, "def f(x):\n    return 1\n"),
    (2, 'SUM   the list\n## output\nthe sum;\n[Input] a LIST', "def f( x ): return 1"),
    (3, "Sum the list. Input: A list. Output: The sum.", "def f(x):\n    return 1\n"),
    (4, PLAIN.replace("A list.", "X").replace("The sum.", "A list.").replace("X", "The sum."), "def f(x):\n    return 1\n"),
    (5, PLAIN, "def f(x):\n    return 2\n"),
    (6, '{"task": "Sum", "input": "A list"}', "y"),
    (7, '{ "INPUT":"a  list!", "task":"sum" }', "Y;"),
    (8, None, "y"),
    (9, "...", "y"),
    (10, "Sum", None),
    (11, "Sum", "?"),
    (12, "'''\r\nsum the list\r\nOUTPUT - The sum\r\n__input__: a list\r\n'''", "DEF F(X): RETURN 1"),
    (13, PLAIN, "def f(x):\n    return 1\n"),
    (14, '{"task": "Sum", ', "y"),
    (15, "x" * 300_000, "z"),
]


def test_records(spark):
    df = spark.createDataFrame([(*r, "extra") for r in RECORDS], "row_id long, prompt string, completion string, record string")
    got = sorted((r.first, r.row_id) for r in R.copies(df).collect())
    assert got == [(1, 2), (1, 12), (1, 13), (6, 7)]
    counts = {r.row_id: r.copies for r in R.records(df).collect()}
    assert counts == {1: 4, 3: 1, 4: 1, 5: 1, 6: 2, 14: 1, 15: 1}
    assert R.records(df.limit(0)).count() == 0 and R.copies(df.limit(0)).count() == 0


def test_sections():
    assert R.sections("lead\nexample of input: none\nInput:\nx\nOutput -\ny") == [("lead", "lead\nexample of input: none"), ("input", "\nx"), ("output", "\ny")]
    assert [k for k, _ in R.sections("﻿{\"b\": [1], \"a\": \"t\"}")] == ["json:b", "json:a"]
    assert [k for k, _ in R.sections("[1, 2]")] == ["lead"]


def test_a_hot_record_is_split(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.lit("Sum").alias("prompt"), F.lit("x").alias("completion"))
    assert R.copies(df).count() == 2999 and R.records(df).first().copies == 3000
    assert R._parts(R.encode(df)).count() == R.SALTS


def test_sifting_keeps_all_matches(spark):
    from loomcurate.llm.sifting import sift

    r = random.Random(15)
    keys = [r.randrange(-(2**63), 2**63) for _ in range(500)] + [None, 0, -1, 2**63 - 1]
    df = spark.createDataFrame([(k, "x") for k in keys], "k long, __x string")
    wanted = spark.createDataFrame([(k,) for k in keys[::5]] + [(None,)], "q long")
    got = {row.k for row in sift(df, "k", wanted).collect()}
    assert {k for k in keys[::5] if k is not None} <= got and None not in got and len(got) < 110
    assert {row.k for row in sift(df, "k", wanted, words=1).collect()} >= got and sift(df, "k", wanted.limit(0)).count() == 0


def test_the_dictionary_has_an_identifier_per_value(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT", 3)
    r = random.Random(14)
    data = [(i, "\n".join(["Sum the list."] + [f"{label}: {r.choice(['yes', 'no', 'a b', 'A-B'])} {r.randrange(9)}" for label in r.sample(["Input", "Output", "Notes"], 3)]), r.choice(["x", "X!", "y"])) for i in range(400)] + [(None, "Sum", "x")]
    df = spark.createDataFrame(data, "row_id long, prompt string, completion string")
    want: dict = {}
    for i, p, c in data:
        want.setdefault(tuple(sorted((label, R.plain(value)) for label, value in R.fields(p, c))), []).append(i)
    got = {row.row_id: row.copies for row in R.records(df).collect()}
    assert got == {ids[0]: len(ids) for ids in want.values()}
    assert {(row.first, row.row_id) for row in R.copies(df).collect()} == {(ids[0], i) for ids in want.values() for i in ids[1:]}
    values = {f for fields in want for f in fields}
    assert len({x for row in R.encode(df).collect() for x in row.record}) == len(values)


def test_a_digest_of_two_values_fails(spark):
    each = spark.createDataFrame([(1, 2, 3), (1, 2, 3), (1, 3, 4)], "d0 long, d1 long, check long")
    assert sorted((r.d1, r.n) for r in R.dictionary(each).collect()) == [(2, 2), (3, 1)]
    with pytest.raises(Exception, match="one digest"):
        R.dictionary(each.union(spark.createDataFrame([(1, 2, 5)], each.schema)))
