import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken

from tracewright.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "  ", "a", "Hello world", "  two  spaces ", "tabs\tand\n\nlines \n x", "don't we'll I'm they've it's he'd", "naïve café — déjà vu", "日本語 テキスト 😀👍🏽",
    "\x00\x01 \x1c\x1d a\x1c b \x85 c\u00a0d \u2003 e\u3000f", "x" * 5000, "ab " * 3000, "<unk> <|endoftext|> Ġ", "12345 6789  １２ ½", "tail \n", "\n head", "a \nb\n c", " lead", "e\u0301 \u0301 x",
]


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_librarys(library):
    bpe = byte_bpe.tokenizer(PATH)
    mixed = TEXTS + [a + b for a in TEXTS for b in TEXTS if len(a) + len(b) < 200]
    for text, packed in zip(mixed, bpe.encode_batch(mixed)):
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode_ordinary(text), repr(text)
        assert bpe.decode(packed) == text.encode()


def test_a_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 3)
    bpe = byte_bpe.ByteBpe(PATH, P.PATTERN)
    for _ in range(2):
        for text in TEXTS:
            assert len(bpe.encode_batch([text])[0]) // 4 == len(library.encode_ordinary(text))


def test_query_rows(spark, library):
    docs = spark.createDataFrame([(1, "Hello there", "z"), (1, "Hello there", "z"), (2, None, "z"), (3, "", None)], "doc_id long, text string, ids string")
    got = sorted(map(tuple, byte_bpe.round_trip(docs, PATH).collect()))
    ids = library.encode_ordinary("Hello there")
    row = (1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(b"Hello there").hexdigest())
    none = (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert got == [row, row, (2, *none), (3, *none)]
    assert byte_bpe.encoded(docs, PATH).where("doc_id = 1").first()["ids"] == ids
    assert byte_bpe.round_trip(docs.where("false"), PATH).count() == 0
