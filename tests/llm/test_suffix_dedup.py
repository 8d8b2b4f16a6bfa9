import random

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import shared
from tracewright.llm import suffix_dedup as sd

M = sd.MIN_WORDS


def brute(rows):
    """Per id: words in a window of M words that an earlier document has, and those that a later one has."""
    docs = {d: (t or "").split() for d, t in rows}
    where = {}
    for d in sorted(docs):
        w = docs[d]
        for i in range(len(w) - M + 1):
            where.setdefault(tuple(w[i : i + M]), []).append((d, i))
    removed, kept = {}, {}
    for seen in where.values():
        least = min(d for d, _ in seen)
        if len({d for d, _ in seen}) > 1:
            for d, i in seen:
                (kept if d == least else removed).setdefault(d, set()).update(range(i, i + M))
    return removed, kept


def corpus(seed):
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared_ = [new(n) for n in (49, 50, 51, 80, 300, 60)]
    boiler = new(30)
    docs = []
    for i in range(60):
        parts = [new(rng.randrange(5, 120))]
        for _ in range(rng.randrange(0, 3)):
            parts += [list(rng.choice(shared_)), new(rng.randrange(0, 40))]
        if i % 2:
            parts += [boiler, new(20)]
        docs.append(sum(parts, []))
    docs += [new(30) + boiler + shared_[1][:25] + new(9), shared_[4], shared_[4], shared_[0], ["a"] * 200, ["b"] * 200, ["b"] * 230, []]
    docs.append(docs[3] + docs[5])
    text = [(rng.choice([" ", "  ", "\n"])).join(d) for d in docs] + [None, " "]
    return [(i * 2, t) for i, t in enumerate(text)]


def words_of(spans):
    return set().union(*(range(s.first, s.last) for s in spans)) if spans else set()


@pytest.mark.parametrize("seed, chunk", [(1, sd.CHUNK), (2, 7)])
def test_all_repeated_windows_are_covered_and_nothing_else(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(sd, "CHUNK", chunk)  # few rows at once: runs go on beyond many edges
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, code string, words int")
    got = {r.doc_id: r for r in sd.repeated_spans(docs).collect()}
    removed, kept = brute(rows)
    assert set(got) == set(removed) | set(kept)
    for d, r in got.items():
        assert words_of(r.removed) == removed.get(d, set()), d
        assert words_of(r.kept) == kept.get(d, set()) - removed.get(d, set()), d


def test_texts_lose_only_later_occurrences(spark):
    rng = random.Random(9)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p, a, b, c = new(70), new(40), new(40), new(500)
    rows = [(1, f"{a}\n{p} {b}"), (2, f"{p}"), (5, f"é {p}  {b} end"), (5, f"é {p}  {b} end"), (7, c), (8, None), (None, p), (9, c + " tail")]
    docs = spark.createDataFrame([(d, t, "z", "c", 1) for d, t in rows], "doc_id long, text string, row string, cuts string, _at int")
    out = sd.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert got == [(1, f"{a}\n{p} {b}"), (2, ""), (5, "é end"), (5, "é end"), (7, c), (8, None), (9, "tail"), (None, p)]
    assert sd.repeated_spans(docs.where("false")).count() == 0


def test_retained_positions_are_the_windows_minima():
    rng = np.random.default_rng(0)
    for top in (5, 10**6):
        g = rng.integers(0, top, 400).astype(np.uint64)
        want = sorted({i + int(np.argmin(g[i : i + sd.WINDOW])) for i in range(len(g) - sd.WINDOW + 1)})
        assert sd.retained(g).tolist() == want


def test_windows_that_neighbours_hide_are_few_and_found():
    """Chunks of sorted suffixes: the spans and the open windows together are all shared windows, whatever hides them."""
    rng = np.random.default_rng(3)
    rows = []
    for row in range(400):
        right = rng.integers(1, 3, rng.integers(0, sd.REACH + 1)).astype(np.uint64).cumsum() if row % 3 else np.arange(sd.REACH, dtype=np.uint64)
        left = np.arange(1, 1 + rng.integers(0, sd.REACH + 1)).astype(np.uint64)
        left[rng.integers(0, len(left)) if len(left) and row % 2 else len(left) :] = row % 5
        rows.append((row // 300, sd._coded(right).tobytes(), sd._coded(left).tobytes(), row, 1000 - row // 2, 40))
    rows.sort()
    names = ["gram", "right", "left", "row", "doc_id", "at"]
    t = pa.table({n: pa.array(c) for n, c in zip(names, zip(*rows))})
    found = sd.compared(t, False, False).to_pandas()
    windows = {}
    for g, right, left, row, doc, at in rows:
        for o in range(sd.REACH + 1):
            if len(left) >= 8 * o and len(right) >= 8 * (sd.REACH - o):
                windows.setdefault((g, left[: 8 * o], right[: 8 * (sd.REACH - o)], o), []).append((doc, row, at - o))
    least, later, unseen = set(), set(), set()
    for held in windows.values():
        for doc, row, first in held:
            if (doc, row) != min(held)[:2]:
                later.add((row, first))
            elif (doc, row) != max(held)[:2]:
                least.add((row, first))
            else:
                unseen.add((row, first))
    covered = {k: {(r, w) for r, f, last in found[found.kind == k][["row", "first", "last"]].itertuples(index=False) for w in range(f, last - M + 1)} for k in (sd.REMOVED, sd.KEPT)}
    opened = set(found[found.kind == sd.OPEN][["row", "first"]].itertuples(index=False, name=None))
    assert covered[sd.REMOVED] <= later and later <= covered[sd.REMOVED] | opened
    assert covered[sd.KEPT] <= later | least and least <= covered[sd.KEPT] | opened
    assert len(opened) < len(later | least | unseen) / 4  # made to hide as many as can be


def test_one_python_step_a_task(spark):
    passage = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, f"{passage} end{i}") for i in range(6)], "doc_id long, text string")
    plan = sd.deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan  # a broadcast join would put two Python steps in a task


def test_steps_give_memory_back(spark, monkeypatch):
    called = []
    monkeypatch.setattr(shared, "give_back", lambda: called.append(1))
    assert list(shared.released(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and called == [1]
    shared.bound_batches(spark)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(shared.READER_ROWS)
