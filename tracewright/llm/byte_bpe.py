"""Byte-level BPE encoding and decoding with a sentencepiece model made straight from a rank vocabulary.

Every vocabulary entry becomes a piece: its bytes are mapped to 256 printable characters and its score is the negative
rank, with identity normalisation. Sentencepiece merges the best-scored pair first, leftmost on ties, which is what a rank
merge does; so each pre-token's ids are the library's ids less one. Texts are cut at spaces between two non-space
characters, where the pre-token pattern always starts a new match; such chunks repeat a lot and are encoded once per
bounded cache. Decoding joins the vocabulary's bytes by id.

Defined cases: a null text counts as empty and has no ids; very long runs are encoded whole; repeated rows each get a row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import shared

#: Chunks kept per worker; at the bound the cache starts anew. Longer chunks are never kept.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48
_ODD_SPACE = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
    return [t for _, t in pairs]


def byte_characters() -> str:
    """256 distinct printable characters: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in set(plain) else chr(next(spare)) for b in range(256))


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks plus one; id 0 is the required unknown piece."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    model = pb.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    t = model.trainer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = pb.TrainerSpec.BPE, len(model.pieces), 0, -1, -1, -1
    n = model.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class ByteBpe:
    """Encoder and decoder; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.tokens))
        self.find = regex.compile(pattern).findall
        self.mapped = dict(enumerate(byte_characters()))
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _learn_pieces(self, missing: list[str]) -> None:
        mapped = [p.encode().decode("latin-1").translate(self.mapped) for p in missing]
        coded = self.model.encode(mapped, out_type=int, num_threads=1)
        packed = (np.fromiter(chain.from_iterable(coded), dtype=np.int64) - 1).astype("<u4").tobytes()
        at = 0
        for piece, ids in zip(missing, coded):
            to = at + 4 * len(ids)
            self.pieces[piece] = packed[at:to]
            at = to

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [self.find(c) for c in chunks]
        missing = set().union(*cut).difference(self.pieces)
        if missing:
            self._learn_pieces(list(missing))
        get = self.pieces.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.chunks) > CACHE_ENTRIES or len(self.pieces) > CACHE_ENTRIES:
            self.chunks, self.pieces = {}, {}
        split = [_CUT.split(t) if _ODD_SPACE.search(t) else t.split(" ") for t in texts]
        heads = [parts[0] for parts in split]  # the only chunks that no space precedes
        words: set[str] = set()
        for parts in split:
            words.update(parts[1:])
        known = self.chunks
        missing = [w for w in words if w not in known]
        known.update(zip(missing, self._encode_chunks([" " + w for w in missing])))
        first = self._encode_chunks(heads)
        get = known.__getitem__
        coded = [head + b"".join(map(get, parts[1:])) for head, parts in zip(first, split)]
        for w in missing:
            if len(w) > CACHE_CHARS:
                del known[w]
        return coded

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    return ByteBpe(path, pattern)


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every text's ids and of the bytes decoded from them. One row per input row, no shuffle."""

    def rows(batches):
        bpe = tokenizer(path)
        for b in _sliced(batches):
            packed = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(rows, _OUT)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids themselves: one row per input row with an array of ids."""

    def rows(batches):
        bpe = tokenizer(path)
        for b in _sliced(batches):
            packed = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            ids = [np.frombuffer(p, dtype="<u4").astype(np.int32) for p in packed]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(rows, "doc_id long, ids array<int>")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
