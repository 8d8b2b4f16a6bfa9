import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import quality

GOOD = ["the cat sat on the mat and looked at rain", "a long day ends with tea and bread", "we walked home along the quiet river"]
BAD = ["buy*** now### cheap$$$ pills%%%", "click### here*** win$$$ win$$$ win$$$", "free%%% money*** now###"]


def rows(n):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        good = i % 3 != 0
        pool = GOOD if good else BAD
        out.append((i, " ".join(pool[j] for j in rng.integers(0, 3, 4)), int(good)))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    data = rows(300)
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in data] + [(900, None, "en"), (901, "", "en"), (902, "x" * 200_000, None), (902, "x" * 200_000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data] + [(0, None, 0), (None, 1, 0), (12345, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, quality.train(docs, labels)


def test_held_out_accuracy_and_whole_table(fitted):
    docs, labels, model = fitted
    got = quality.scored(docs, model).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got)
    y = {i: q for i, _, q in rows(300)}
    held = [r for r in got if r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 40 and np.mean([(r.score >= quality.THRESHOLD) == y[r.doc_id] for r in held]) > 0.97
    same = [r.score for r in got if r.doc_id == 902]
    assert same[0] == same[1]


def test_held_out_labels_are_never_read(spark, fitted):
    docs, labels, model = fitted
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    again = quality.train(docs, flipped)
    assert (again.weights == model.weights).all() and again[2:] == model[2:]


def test_the_bound_holds_and_one_class_gives_the_share(spark, fitted):
    docs, labels, _ = fitted
    assert quality.train(docs, labels.where("quality = 1")).slope == 0.0
    none = quality.train(docs, labels.where("false"))
    assert np.allclose(quality.score_texts(pa.array(["a", None]), none), 0.5)
    assert quality.scored(docs.where("false"), none).count() == 0


def test_features_match_a_plain_count():
    flat, bounds = quality.features(pa.array(["a b a b", "", None, "Zz-9 zz-9"]))
    assert list(np.diff(bounds) > 0) == [True, False, False, True]
    one, _ = quality.features(pa.array(["a b a b"]))
    assert (one == flat[: bounds[1]]).all() and len(set(one)) == len(one)


def test_descent_and_curve_match_a_plain_solver():
    rng = np.random.default_rng(5)
    data = rows(200)
    flat, bounds = quality.features(pa.array([" ".join(rng.permutation(t.split())) + " the cat" * int(rng.integers(0, 3)) for _, t, _ in data]))
    xs = [flat[a:e] for a, e in zip(bounds[:-1], bounds[1:])]
    labels = np.array([k for _, _, k in data])
    labels[rng.integers(0, 200, 25)] ^= 1  # not separable
    y = np.where(labels > 0, 1.0, -1.0)

    r = quality.log_count_ratios(xs, y)
    pos, neg = ({f: sum(f in set(x.tolist()) for x, v in zip(xs, y) if v == sign) for f in set(flat.tolist())} for sign in (1, -1))
    width = 1 << quality.BITS
    sums = [sum(c.values()) + width for c in (pos, neg)]
    assert all(np.isclose(r[f], np.log((pos[f] + 1) / sums[0]) - np.log((neg[f] + 1) / sums[1])) for f in pos)

    used = np.unique(flat)
    dense = np.zeros((200, len(used) + 1))
    for i, x in enumerate(xs):
        dense[i, np.searchsorted(used, x)] = r[x] / (np.linalg.norm(r[x]) or 1.0)
    dense[:, -1] = 1.0  # the bias
    top = np.where(y > 0, 100 / (y > 0).sum(), 100 / (y < 0).sum())
    gram = (dense @ dense.T) * np.outer(y, y)
    alpha, ahead = np.zeros(200), np.zeros(200)
    step = 1 / np.linalg.eigvalsh(gram).max()
    for k in range(20000):  # projected gradient with momentum on the dual
        new = np.clip(ahead - step * (gram @ ahead - 1), 0, top)
        ahead, alpha = new + k / (k + 3) * (new - alpha), new
    best = dense.T @ (alpha * y)

    def loss(w):
        return 0.5 * w @ w + (top * np.maximum(0, 1 - y * (dense @ w))).sum()

    w, bias = quality.dual_descent(xs, y, r, epochs=400, drawn=1.0)
    assert np.allclose(np.r_[w[used], bias], best, atol=2e-3) and not np.delete(w, used).any()
    w, bias = quality.dual_descent(xs, y, r, drawn=1.0)
    assert loss(np.r_[w[used], bias]) <= 1.05 * loss(best)

    m = rng.normal(y, 1.0)
    a, b = quality.logistic(m, y)
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    gap = 1 / (1 + np.exp(-a * m - b)) - t
    assert abs(gap @ m) < 1e-3 and abs(gap.sum()) < 1e-3


def test_training_gives_memory_back(spark, monkeypatch):
    from tracewright.llm import quality as q

    called = []
    monkeypatch.setattr(q.shared, "give_back", lambda: called.append(1))
    docs = spark.createDataFrame([(i, f"text of {i}") for i in range(12)], "doc_id long, text string")
    q.train(docs, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int"))
    assert called == [1]
