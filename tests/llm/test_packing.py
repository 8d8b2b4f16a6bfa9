import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tracewright.llm import packing, word_bpe

PATH = P.path("word_bpe_49k.json")
TEXTS = [
    "", " \n", "Hello, World's ENDS don't we'll", "naïve CAFÉ 123 １２ ½", "日本語 テキスト 😀👍🏽 Ωσ ΣΑΣ", "a\x1cb \x1d c\x85d e f g", "é ́x İstanbul ǅ", "x" * 3000, "!!! ??? ...,,, <|endoftext|> </w>",
    "the quick brown fox " * 50, "Erheed, ndonan. thnt; êeux ññ çleque Größe straße", "'s ''t 're'", "\x00 \x7f ÿ þ",
    "hello <|endoftext|> world", "a<|startoftext|>B<|endoftext|>.", "<|ENDOFTEXT|> <| endoftext|> <|endoftext|", "é<|endoftext|>\u3000<|endoftext|>x",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyzéèüñ'0-.")
    words = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(4000)]
    texts = TEXTS + [" ".join(words[i : i + 40]) for i in range(0, 4000, 40)]
    for text, got in zip(texts, word_bpe.tokenizer(PATH).encode_batch(texts)):
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode(text, add_special_tokens=False).ids, text


def test_every_word_of_the_vocabulary_agrees(library):
    _, ids, _ = word_bpe.vocabulary(PATH)
    words = []
    for t in ids:
        try:
            words.append(t.rstrip(b"\xff").decode())
        except UnicodeDecodeError:
            pass
    got = word_bpe.tokenizer(PATH).encode_batch(words)
    want = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(g) // 4}I", g)) for g in got] == want


def check(rows, ids, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, rs in by_doc.items():
        rs.sort(key=lambda r: r.piece)
        n = len(ids[doc])
        assert [(r.piece, r.start, r.length) for r in rs] == [(i, s, min(capacity, n - s)) for i, s in enumerate(range(0, n, capacity))]
        for r in rs:
            part = ids[doc][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    for rs in by_seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))] and sum(r.length for r in rs) <= capacity
    return len(by_seq)


def test_every_piece_is_packed_once_and_tightly(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ITEMS", 60)  # several cells and levels
    rng = np.random.default_rng(2)
    texts = TEXTS + ["word " * int(n) for n in np.r_[rng.integers(1, 40, 300), 300, 128, 127]]
    data = [(i, t, 1) for i, t in enumerate(texts)] + [(9000, None, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, offset int")
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in data}
    used = check(packing.packed(docs, PATH, 128).collect(), ids, 128)
    assert used <= -(-sum(map(len, ids.values())) // 128) + 2
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.length for r in packing.packed(twice, PATH, 128).collect()) == [1, 3, 3]
    assert packing.packed(twice.where("false"), PATH, 128).count() == 0


def test_crossover_keeps_a_valid_packing_and_evolving_helps():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 70, 400)
    population = packing.first_population(lengths, 100, 4, rng)
    child = packing.crossover(population[0], population[1], lengths, 100, rng)
    for p in (*population, child):
        assert np.bincount(p, weights=lengths).max() <= 100 and (np.bincount(p) > 0).all()
    best = packing.evolve(lengths, 100, population, 40, rng)
    assert packing.fitness(best, lengths, 100) >= max(packing.fitness(p, lengths, 100) for p in population)
    assert best.max() < min(p.max() for p in population)  # crossover saves bins


def most_that_fit(lengths, capacity):
    """The least number of bins, by trying all ways."""
    best, items = [len(lengths)], sorted(lengths, reverse=True)

    def place(i, free):
        if len(free) >= best[0]:
            return
        if i == len(items):
            best[0] = len(free)
            return
        for f in {f for f in free if f >= items[i]}:
            at = free.index(f)
            place(i + 1, [*free[:at], f - items[i], *free[at + 1 :]])
        place(i + 1, [*free, capacity - items[i]])

    place(0, [])
    return best[0]


def test_small_packings_are_the_best_there_are():
    rng = np.random.default_rng(6)
    for _ in range(30):
        lengths = rng.integers(5, 60, 9)
        population = packing.first_population(lengths, 100, 4, rng)
        assert packing.evolve(lengths, 100, population, 40, rng).max() + 1 == most_that_fit(lengths.tolist(), 100)


def test_pieces_that_fill_no_bin_are_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ITEMS", 20)  # more cells than one, so that bins with room would go on
    for lengths, most in (([70] * 100, 100), ([70] * 100 + [50] * 60, 104), ([40] * 100, 38)):
        items = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
        folder = packing.shared.work_folder(spark)
        rows = packing.pack(items, folder, 128).collect()
        assert all(began >= bins for began, bins in packing.saved_by_crossover(folder, spark))
        assert sorted((r.id, r.length) for r in rows) == list(enumerate(lengths))
        fill = {}
        for r in rows:
            fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        assert max(fill.values()) <= 128 and len(fill) <= most
