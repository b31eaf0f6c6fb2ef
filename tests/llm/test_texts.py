import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomcurate.llm import leakage as L
from loomcurate.llm import packing as K
from loomcurate.llm import pii as P
from loomcurate.llm import tokens as T

ODD = [None, "", "   ", "one word", "\x00", "a" * 400_000, " " * 300_000, "x. " * 60_000, "😀".encode("utf-16", "surrogatepass").decode("utf-16") * 1000]


def test_packing_plan():
    r = random.Random(1)
    for histogram in ({700: 1000, 1000: 500, 1100: 300, 900: 200, 1400: 100, 300: 50}, {r.randint(1, 2048): r.randint(1, 90) for _ in range(200)}, {2048: 3}, {1: 5}, {}):
        plan = K.pack_histogram(histogram, 2048, 200)
        used = {}
        placed = {}
        for length, rank, sequence, each in zip(plan.length, plan.first_rank, plan.first_sequence, plan.each):
            later = plan.first_rank[(plan.length == length) & (plan.first_rank > rank)]
            end = int(later.min()) if len(later) else histogram[int(length)]
            placed[int(length)] = placed.get(int(length), 0) + end - int(rank)
            for i in range(end - int(rank)):
                s = int(sequence) + i // int(each)
                used[s] = used.get(s, 0) + int(length)
        assert placed == histogram and all(v <= 2048 for v in used.values()) and len(used) == plan.sequences
        assert plan.lower_bound <= plan.sequences + 1e-9 and plan.sequences <= 1.12 * plan.lower_bound + 2


def test_knapsack_is_exact():
    import numpy as np

    lengths, values = np.array([3, 5, 7]), np.array([3.1, 5.6, 7.2])
    value, used = K.best_configuration(lengths, values, 17)
    best = max(a * 3.1 + b * 5.6 + c * 7.2 for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 17)
    assert value == pytest.approx(best) and sum(lengths[i] * n for i, n in used.items()) <= 17


def test_packing_of_documents(spark):
    r = random.Random(2)
    texts = [" ".join(f"word{r.randrange(999)}" for _ in range(r.choice([1, 5, 5, 5, 40, 120, 700]))) for _ in range(300)] + ODD
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    packed = K.pack(df, 256).cache()
    rows = packed.collect()
    sizes = {i: T.count_tokens(t, T.default_vocabulary()) for i, t in enumerate(texts)}
    pieces: dict = {}
    for row in rows:
        pieces.setdefault(row.doc_id, []).append(row)
    assert set(pieces) == set(sizes)
    for i, own in pieces.items():
        own.sort(key=lambda x: x.piece)
        assert sum(x.n_tokens for x in own) == sizes[i] and [x.start_token for x in own] == [256 * k for k in range(len(own))]
        assert len(own) == max(1, -(-sizes[i] // 256)) and (own[0].sequence_id is None) == (sizes[i] == 0)
    fill = K.fill(packed, 256).collect()
    assert all(0 < f.used_tokens <= 256 for f in fill) and sum(f.used_tokens for f in fill) == sum(sizes.values())
    assert len(fill) <= 1.02 * -(-sum(sizes.values()) // 256) + 1
    assert K.pack(df.limit(0), 256).count() == 0


def naive(text, items, run=12, least=6):
    w = L.canonical(text)
    found = set()
    for ident, prompt in items:
        v = L.canonical(prompt)
        k = min(run, len(v))
        if len(v) >= least and {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}:
            found.add(ident)
    return found


@pytest.mark.parametrize("part", [300, 2_000_000])
def test_leaks_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(L, "PART_CHARS", part)
    r = random.Random(3)
    vocabulary = ["of", "a", "in", "list"] + [f"w{i}" for i in range(60)]
    sentence = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(f"t{i}", " ".join(sentence(r.choice([3, 6, 8, 11, 12, 13, 30])))) for i in range(40)] + [("null", None), (None, "x " * 20), ("repeat", "list " * 14)]
    docs = []
    for i in range(150):
        w = sentence(r.randrange(0, 120))
        for _ in range(r.randrange(3)):
            v = L.canonical(r.choice(items)[1])
            a = r.randrange(len(v) + 1)
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() if r.random() < 0.2 else x for x in v[a : a + r.choice([8, 11, 12, 13, 40])]]
        docs.append((i, r.choice([" ", ", ", "\n", "­ "]).join(w), "clash"))
    docs += [(1000 + i, t, "clash") for i, t in enumerate([None, "", "  ", "list " * 60, "ｗ１ " * 20])]
    docs.append((2000, docs[0][1], "clash"))
    got = [tuple(x) for x in L.leaks(spark.createDataFrame(docs, "doc_id long, text string, task_id string"), spark.createDataFrame(items, "task_id string, prompt string")).collect()]
    want = {(d, t) for d, text, _ in docs for t in naive(text, [x for x in items if x[0]])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 15


def test_leaks_in_blocks_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_CHARS", 60)
    docs = spark.createDataFrame([(1, "please write a function that adds two big numbers now"), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(f"t{i}", "write a function that adds two big numbers" if i == 5 else f"other words number {i} in this long item") for i in range(9)], "task_id string, prompt string")
    assert [tuple(r) for r in L.leaks(docs, items).collect()] == [(1, "t5")]
    assert L.leaks(docs, items.limit(0)).count() == 0 and L.leaks(docs.limit(0), items).count() == 0
    near = spark.createDataFrame([(1, "please write a function that add two big numbers now"), (2, "write a function"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in L.leaks(near, items, edits=1).collect()] == [(1, "t5")]


def test_leaks_with_edits(spark):
    item = "return the number of ways to climb a stair of n steps with jumps"
    docs = [(1, f"so: {item} ok"), (2, f"so: {item.replace('climb', 'clinb')} ok"), (3, f"so: {item.replace('climb a', 'clib an')} ok"), (4, "return the sum of all ways to cross a river of stones in a boat now")]
    items = spark.createDataFrame([("t", item)], "task_id string, prompt string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in L.leaks(df, items, edits=0).collect()) == [1]
    assert sorted(r.doc_id for r in L.leaks(df, items, edits=2).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="edits"):
        L.leaks(df, items, edits=99)


def test_no_passage_is_put_together_from_two_documents(spark):
    words = [f"word{i}" for i in range(24)]
    items = spark.createDataFrame([("long", " ".join(words)), ("short", " ".join(words[:12]) + " more")], "task_id string, prompt string")
    chunks = [(1, "before " + " ".join(words[:14])), (2, " ".join(words[14:]) + " after"), (3, "x " + " ".join(words[:6])), (4, " ".join(words[6:12]) + " y"), (5, " ".join(words[3:9])), (6, " ".join(words[9:16]))]
    df = spark.createDataFrame(chunks, "doc_id long, text string").coalesce(1)
    for edits in (0, 1, 2):
        got = {tuple(r) for r in L.leaks(df, items, edits).collect()}
        assert got == {(1, "long"), (1, "short")}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def close(text, items, edits, run=12, least=6):
    """Items with a passage within the edits of a run of whole words, by trying all of them."""
    w, found = L.canonical(text), set()
    for ident, prompt in items:
        v = L.canonical(prompt)
        k = min(run, len(v))
        passages = [" ".join(v[i : i + k]) for i in range(len(v) - k + 1)] if len(v) >= least else []
        runs = [" ".join(w[i : i + n]) for n in range(max(1, k - edits), k + edits + 1) for i in range(len(w) - n + 1)]
        if any(abs(len(p) - len(r)) <= edits and distance(p, r) <= edits for p in passages for r in runs if edits or len(p) == len(r)):
            found.add(ident)
    return found


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_leaks_with_edits_equal_brute_force(spark, monkeypatch, edits):
    monkeypatch.setattr(L, "PART_CHARS", 400)
    r = random.Random(5 + edits)
    vocabulary = ["of", "a", "in", "list"] + [f"w{i}" for i in range(30)]
    items = [(f"t{i}", " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 6, 8, 12, 14, 20])))) for i in range(12)]
    docs = []
    for i in range(60):
        w = " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 15)))
        v = r.choice(items)[1]
        for _ in range(r.randrange(4)):
            at = r.randrange(len(v))
            v = r.choice([v[:at] + v[at + 1 :], v[:at] + r.choice("x 1") + v[at:], v[:at] + r.choice("x 1") + v[at + 1 :]])
        docs.append((i, w + " " + v[r.choice([0, 0, 0, 20]) :] + r.choice([" ", ""]) + w[:9]))
    want = {(d, t) for d, text in docs for t in close(text, items, edits)}
    got = {tuple(x) for x in L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "task_id string, prompt string"), edits).collect()}
    assert got == want and len(want) > 3


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ab ", min_size=1, max_size=9), st.text("ab \0", max_size=12), st.integers(0, 3)), min_size=1, max_size=6), st.integers(0, 3))
def test_alignment_of_many_equals_plain_distances(cases, edits):
    import numpy as np

    raw = lambda s: np.frombuffer(s.encode(), np.uint8)
    text = "\0".join(t for _, t, _ in cases)
    letters, at, starts, want, size, before = "", [], [], [], 0, 0
    for pattern, t, shift in cases:
        shift = min(shift, len(t))
        at.append(len(letters))
        letters += pattern
        starts.append(before + shift)
        rest = t[shift:].split("\0")[0]
        ends = [i for i in range(len(rest) + 1) if i == len(rest) or rest[i] == " "]
        want.append(any(distance(pattern, rest[:i]) <= edits for i in ends))
        before += len(t) + 1
    got = L.aligned(raw(letters), np.array(at), np.array([len(p) for p, *_ in cases]), raw(text), np.array(starts), edits)
    assert got.tolist() == want


def test_canonical():
    assert L.canonical("Ｆoo­bar ​Bé ﬁx") == ["foobar", "b", "fix"] and L.canonical(None) == []
    assert all(unicodedata.category(c) == "Cf" for c in "­​⁠")


PII = [
    ("Mail jo.doe@codekiln.example, please", [("email", "jo.doe@codekiln.example")]),
    ("mailto:a_b+c@mail.x.org?subject=hi", [("email", "a_b+c@mail.x.org")]),
    ("<jo＠example.net>", [("email", "jo＠example.net")]),
    ("reach me at jdoe at ridge-data dot example or", [("email", "jdoe at ridge-data dot example")]),
    ("j.doe [at] mail[dot]org", [("email", "j.doe [at] mail[dot]org")]),
    ("use user@ and @functools.cache, pin toolbox@1.2.3, a @ b", []),
    ("Ask at the budget dot on the map", []),
    ("tel:+1 (674) 555-0142 / fax 01 99 00 12 34", [("phone", "+1 (674) 555-0142"), ("phone", "01 99 00 12 34")]),
    ("Call me ((826) 555 0182) or +49 (0)30-23125786 ext. 3", [("phone", "(826) 555 0182"), ("phone", "+49 (0)30-23125786")]),
    ("Call 0800 times and you get 1560-8134-69 at 12:19, build 2026.04.50", []),
    ("SSN 666-12-3906 and QQ 31 54 09 B", [("id_number", "666-12-3906"), ("id_number", "QQ 31 54 09 B")]),
    ("rows 666 00 5495", [("id_number", "666 00 5495")]),
    ("Die Steuer-ID 00 749 172 163 und Pass XR 0437047", [("id_number", "00 749 172 163"), ("id_number", "XR 0437047")]),
    ("身份证号 990836198309061924 出现", [("id_number", "990836198309061924")]),
    ("Checksums 003404077 and QQ-59dbe1b differ; batch 666 of 434", []),
    ("moved to Flat 6, 223 Saltmarsh Close last", [("street_address", "Flat 6, 223 Saltmarsh Close")]),
    ("at 25 Quarrygate Rd., Apt 4B wants", [("street_address", "25 Quarrygate Rd., Apt 4B")]),
    ("wohnhaft Lindquellstraße 2 b, dann 11 bis, chemin du Ottervale", [("street_address", "Lindquellstraße 2 b"), ("street_address", "11 bis, chemin du Ottervale")]),
    ("寄到云杉巷24号，收件人慕容砚禾。", [("street_address", "云杉巷24号"), ("person_name", "慕容砚禾")]),
    ("Look at line 14 Main Loop and at lane 3 Road Test", []),
    ("Reviewed with Halina Quensović's team and N. Umberstead", [("person_name", "Halina Quensović"), ("person_name", "N. Umberstead")]),
    ("Contact: Dr. TOBIN K. LUNDQUIST, (Dunnsund, Corwin), anselm velmetti", [("person_name", "TOBIN K. LUNDQUIST"), ("person_name", "Dunnsund, Corwin"), ("person_name", "anselm velmetti")]),
    ("Thanks to Marla and Tobin; Merge Sort by the Linked List team; @quirin_dev", []),
    ("already <EMAIL> and [PHONE]", []),
]


@pytest.mark.parametrize("text,want", PII)
def test_pii(text, want):
    spans = P.Finder().spans(text)
    assert [(k, text[a:b]) for a, b, k in spans] == want
    redacted = P.redact(text, spans)
    assert not any(w in redacted for _, w in want) and P.Finder().spans(redacted) == []


SIGNED = [
    ("Signed-off-by: Wilhelmina Garcia <w@x.org>", ["Wilhelmina Garcia"]),
    ("Author: Zoltan B. Okafor-Reyes's patch", ["Zoltan B. Okafor-Reyes"]),
    ("Best regards,\nOluwaseun Adeyemi\n", ["Oluwaseun Adeyemi"]),
    ("Contact: T. Nakamura or Contact: Support Team", ["T. Nakamura"]),
    ("收件人：王伟，联系人张小明电话", ["王伟", "张小明"]),
    ("Mit freundlichen Grüßen, Bettina Kestdottir Gestern\nAuthor: Uma Lucia Garcia\nWir", ["Bettina Kestdottir", "Uma Lucia Garcia"]),
    ("The author wrote Merge Sort; contact The Data Team", []),
]


@pytest.mark.parametrize("text,want", SIGNED)
def test_strong_cues_propose_names(text, want):
    assert [text[a:b] for a, b, k in P.Finder().spans(text) if k == "person_name"] == want


def test_lists_of_names_are_parameters(spark):
    df = spark.createDataFrame([(1, "so Oluwaseun Adeyemi then")], "doc_id long, text string")
    assert P.find_pii(df).count() == 0
    assert [r.pii_text for r in P.find_pii(df, ["oluwaseun"], ["yemi"]).collect()] == ["Oluwaseun Adeyemi"]
    assert P.redact_pii(df, ["oluwaseun"], ["yemi"]).first().text == "so <PERSON_NAME> then"


def test_phones_written_with_00_are_found_whatever_their_digits():
    finder, r = P.Finder(), random.Random(4)
    numbers = ["0049 30 " + "".join(r.choices("0123456789", k=8)) for _ in range(300)]
    assert sum(P.luhn(P._digits(n)) for n in numbers) > 15
    for text in ("Tel. {}", "bei {} melden"):
        assert all([(k, t[a:b]) for a, b, k in finder.spans(t)] == [("phone", n)] for n in numbers for t in [text.format(n)])


def test_numbers_confirmed_by_mod_97_and_luhn():
    found = lambda t: [(k, t[a:b]) for a, b, k in P.Finder().spans(t)]
    number = 1850578006084
    key = 97 - number % 97
    assert found(f"vu 1 85 05 78 006 084 {key:02}, puis") == [("id_number", f"1 85 05 78 006 084 {key:02}")]
    assert found(f"vu {number}{key:02}") == [("id_number", f"{number}{key:02}")] and found(f"vu {number}{key % 97 + 1:02}") == []
    corsica = 97 - 1850519006084 % 97
    assert found(f"vu 185052A006084{corsica:02}") == [("id_number", f"185052A006084{corsica:02}")]
    assert found("his SIN: 130 692 544") == [("id_number", "130 692 544")] and found("rows 130 692 544") == []
    assert found("his SIN: 130 692 545") == []


def test_accounts_and_cards_are_confirmed_by_their_check_digits(spark):
    found = lambda t: [(k, t[a:b]) for a, b, k in P.Finder().spans(t)]
    assert found("to DE89 3704 0044 0532 0130 00, please") == [("bank_account", "DE89 3704 0044 0532 0130 00")]
    assert found("GB82WEST12345698765432") == [("bank_account", "GB82WEST12345698765432")]
    assert not any(k == "bank_account" for k, _ in found("to DE88 3704 0044 0532 0130 00, please"))
    assert found("pay 4111 1111 1111 1111 now") == [("payment_card", "4111 1111 1111 1111")] and found("pay 4111 1111 1111 1112 now") == []
    assert found("amex 3782 822463 10005") == [("payment_card", "3782 822463 10005")]
    assert found("Visa card: 4111111111111111") == [("payment_card", "4111111111111111")] and found("run 4111111111111111") == []
    df = spark.createDataFrame([(1, "pay 4111 1111 1111 1111 now")], "doc_id long, text string")
    assert P.redact_pii(df).first().text == "pay <PAYMENT_CARD> now" and P.find_pii(df, types=["phone"]).count() == 0


# Names that are in no list, in contexts of many kinds, and phrases that only look like names.
PEOPLE = [
    ("Contact Dmytro Volkov or Anwar Haddad", ["Dmytro Volkov", "Anwar Haddad"]),
    ("Priya Raman and Takumi Mori fixed it", ["Priya Raman", "Takumi Mori"]),
    ("we met Ngozi Okonkwo, Thandiwe Nkosi and Bjarne Holm there", ["Ngozi Okonkwo", "Thandiwe Nkosi", "Bjarne Holm"]),
    ("Katarzyna Wojcik said no", ["Katarzyna Wojcik"]),
    ("Dear Ms. Siobhan O'Rourke,", ["Siobhan O'Rourke"]),
    ("Herr Jürgen Vogel und Frau Anneliese Kraus", ["Jürgen Vogel", "Anneliese Kraus"]),
    ("Bonjour Élodie Garnier, ça va", ["Élodie Garnier"]),
    ("Prof. Hyun-woo Park wrote a reply", ["Hyun-woo Park"]),
    ("Then Ronan McAllister confirmed the fix", ["Ronan McAllister"]),
    ("please tell Zainab Qureshi about it", ["Zainab Qureshi"]),
    ("Signed-off-by: Tobias Eklund <t@e.org>", ["Tobias Eklund"]),
    ("联系李娜说明情况，王芳老师回复", ["李娜", "王芳"]),
    ("asked Merlin Achterberg yesterday", []),
]
LOOKALIKES = [
    "Merge Sort and Binary Search said nothing", "contact Support Team", "ask Data Platform", "Hello World Bank", "Dear Customer Service", "see Linked List, Hash Map and Red Black Tree",
    "call Next Step when done; the next step follows", "The Quick Start says so", "Big Query joined Cloud Run", "New York called", "Use Python Package Index", "the team asked Open Source Initiative",
    "Error Handling said", "张量表示方法", "由于任务说明", "If Anyone asks",
]


def test_names_in_no_list():
    finder = P.Finder()
    names = lambda t: [t[a:b] for a, b, k in finder.spans(t) if k == "person_name"]
    want = sum(len(w) for _, w in PEOPLE)
    right = sum(len(set(w) & set(names(t))) for t, w in PEOPLE)
    wrong = sum(len(set(names(t)) - set(w)) for t, w in PEOPLE) + sum(len(names(t)) for t in LOOKALIKES)
    print({t: names(t) for t, w in PEOPLE if names(t) != w}, {t: names(t) for t in LOOKALIKES if names(t)})
    assert right / want >= 0.9 and right / (right + wrong) >= 0.9


def test_validators():
    assert P.luhn("4539578763621486") and not P.luhn("4539578763621487")
    assert P.mod97("GB82 WEST 1234 5698 7654 32") and not P.mod97("GB82 WEST 1234 5698 7654 33")
    assert P.mod11_2("11010519491231002X") and P.mod11_10("86095742719")


def test_pii_of_tables(spark):
    texts = [p[0] for p in PII] + ODD + ["1" * 300_000, "a@" * 100_000, "A. " * 60_000, "Anselm " * 20_000, "+1 " * 60_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, PII[0][0] * 2, "clash")], "doc_id long, text string, pii_type string")
    found = P.find_pii(df).collect()
    assert len(found) == len(set(found)) and {(r.pii_type, r.pii_text) for r in found if r.doc_id is None} == set(PII[0][1])
    back = {r.doc_id: r.text for r in P.redact_pii(df).collect()}
    assert back[len(PII)] is None and back[len(PII) + 1] == "" and len(back) == len(texts) + 1
    assert P.find_pii(df.limit(0)).count() == 0 and P.redact_pii(df.limit(0)).count() == 0


def test_token_counts_are_cut_safely(monkeypatch):
    path = T.default_vocabulary()
    text = " ".join(f"word{i}, it's 12 km" for i in range(400))
    whole = T.count_tokens(text, path)
    monkeypatch.setattr(T, "_LONG", 50)
    assert T.count_tokens(text, path) == whole and T.count_tokens(None, path) == 0
