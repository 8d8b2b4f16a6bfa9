import hashlib

import numpy as np

from tracewright.llm import fingerprint as fp

ROWS = [(5, "wörld " * 40, "x"), (1, None, "y"), (3, "", "z"), (9, "a", None), (7, "The quick brown fox. " * 30, "x"), (8, "The quick brown fox. " * 30, "x"), (2, "日本語のテキスト" * 9, "")]


def brute(rows):
    rows = sorted(((k, t or "") for k, t, _ in rows), key=lambda r: (r[0], r[1]))
    out = {}
    for i, (k, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        a, b, c = fp.digest(t.encode()), fp.digest(e.encode()), fp.digest(following.encode())
        out[k] = (len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c))
    return out


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, bucket string")
    got = {r[0]: tuple(r[1:]) for r in fp.fingerprints(docs).collect()}
    assert got == brute(ROWS)


def test_one_row_is_its_own_successor_and_empty_table(spark):
    docs = spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")
    assert fp.fingerprints(docs).collect()[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert fp.fingerprints(docs.where("false")).count() == 0


def test_repeated_rows_each_have_a_row(spark):
    docs = spark.createDataFrame([(4, "abcdef"), (4, "abcdef"), (None, "q"), (6, "xyz")] * 2, "doc_id long, text string")
    assert fp.fingerprints(docs).count() == 8


def test_hot_keys_and_hot_rows_are_split_and_followed(spark, monkeypatch):
    monkeypatch.setattr(fp, "SAMPLE", 8)
    rows = [(7, f"text {i} " * (i % 5)) for i in range(120)] + [(7, "again")] * 60 + [(i, f"own {i}") for i in range(40)] + [(None, "no key")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sent = fp.with_next(docs, "doc_id", "text").collect()
    assert len({r.bucket for r in sent if r.key == 7}) > 1 and sum(r.tail for r in sent) == len({r.bucket for r in sent})
    got = fp.fingerprints(docs).collect()
    assert len(got) == len(rows)
    own = {}
    for r in got:
        own.setdefault(r.fingerprint, []).append(r)
    again = own[fp.digest(b"again")]
    assert len(again) == 60 and sum(r.near_next == 1.0 for r in again) >= 59  # each but the last is followed by its copy


def test_places_are_those_of_a_sorted_list():
    rng = np.random.default_rng(1)
    bounds = np.unique(np.array([tuple(x) for x in rng.integers(-2, 3, (9, 3))], dtype=fp._TRIPLE))
    k, h, r = rng.integers(-2, 3, (3, 500))
    want = [sum(tuple(b) <= x for b in bounds.tolist()) for x in zip(k, h, r)]
    assert fp._places(k, h, r, bounds).tolist() == want


def test_likeness_is_bounded_and_orders_edits():
    base = ("Some words repeat and some words differ, number %d. " * 50) % tuple(range(50))
    near, far = base[:-300] + "x" * 300, "zq jv kx " * 300
    a = fp.digest(base.encode())
    assert fp.likeness(a, a) == 1.0
    assert fp.likeness(a, fp.digest(near.encode())) > fp.likeness(a, fp.digest(far.encode())) >= 0.0
    assert fp.difference(a, fp.digest(b"")) <= fp.FULL_DIFFERENCE
