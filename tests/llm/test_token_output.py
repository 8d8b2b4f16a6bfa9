import zlib

import numpy as np
import pytest

from tracewright.llm import byte_bpe, shared, token_output as to


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_slots_are_a_keyed_permutation(n):
    x = np.arange(n)
    s = to.slots(x, n)
    assert sorted(s) == list(range(n)) and (to.numbers(s, n) == x).all()
    if n >= 1000:
        assert (to.slots(x, n, 5) != s).mean() > 0.9 and abs(np.corrcoef(x, s)[0, 1]) < 0.1


def test_shards_hold_every_sequence_at_its_slot(spark):
    texts = ["a b c", None, "", "long words follow " * 700, "é日本", "a b c"]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(0, "a b c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    folder = shared.work_folder(spark)
    got = to.write_shards(docs, folder, shard_rows=4).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n)) and len({r.shard for r in got}) == -(-n // 4)
    bpe = byte_bpe.tokenizer(to.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    stored = to.read_slots(folder, 0, n + 5, 4)
    assert len(stored) == n
    assert all((a == b).all() for a, b in zip(to.read_slots(folder, 3, 4, 4), stored[3:7]))
    whole = {}
    for r in got:
        ids = stored[r.slot]
        record = ids.astype("<u2").tobytes().ljust(to.STRIDE, b"\xff")
        assert len(ids) == r.length and r.record_crc32 == zlib.crc32(record) and (r.shard, r.byte_offset) == (r.slot // 4, r.slot % 4 * to.STRIDE)
        for doc, a, e, at in zip(r.doc_ids, r.record_starts, [*r.record_starts[1:], r.length], r.doc_starts):
            whole.setdefault(doc, []).append((at, ids[a:e].tolist()))
    want = {i: [*np.frombuffer(bpe.encode_batch([t or ""])[0], dtype="<u4").tolist(), to.END] for i, t in enumerate(texts)}
    assert set(whole) == set(want)
    for i, ids in want.items():
        copies = [x for x in whole[i]] if i else [x for x in whole[i] if x[0] == 0][:1]
        assert sum((x for _, x in sorted(copies)), []) == ids
    assert [x for x in whole[0] if x[0] == 0] == [(0, want[0])] * 2


def test_few_writers_null_ids_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(to, "WRITERS", 2)
    rows = [(None if i % 3 else i, f"text number {i} " * 90, i, b"x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long, ids binary").repartition(3)
    folder = shared.work_folder(spark)
    got = to.write_shards(docs, folder, shard_rows=3).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and len({r.shard for r in got}) == -(-len(got) // 3) > 4
    stored = to.read_slots(folder, 0, len(got), 3)
    assert all(len(stored[r.slot]) == r.length for r in got)
    assert {d for r in got for d in r.doc_ids} == {None, *range(0, 40, 3)}
    assert sum(1 for r in got for at in r.doc_starts if at == 0) == 40


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert to.write_shards(docs, shared.work_folder(spark)).count() == 0
