"""Ids of the word-end BPE vocabulary, equal to the tokenizers library's, at the speed of cached chunks.

The vocabulary lower-cases, drops white space and marks word ends, so a text's ids are those of its white-space-separated
chunks in order. A chunk of characters below U+0300 is split here and merged by tiktoken's core, with the word end as a byte
that UTF-8 never has; any other chunk goes to the library. Tiktoken merges by the joined bytes, the library by listed pairs;
they agree unless some merge inside a resulting token joins an unlisted pair. Tokens for which that can happen are found once
(unlisted_tokens), and a chunk that yields one goes to the library too, as does one that may hold a special token's string.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from tracewright.llm import byte_bpe

_END = b"\xff"
#: White space of the library; str.split() also cuts at the four separators 0x1C-0x1F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BEYOND = re.compile("[̀-\U0010ffff]")


def _byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_bpe.byte_characters())}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[bytes, int], frozenset[tuple[bytes, bytes]]]:
    """Ranks by bytes (word ends as a last 0xFF), ids by bytes, and the listed pairs."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte_of = _byte_of()

    def raw(token: str) -> bytes:
        ends = token.endswith("</w>") and token != "</w>"
        return bytes(byte_of[c] for c in (token[:-4] if ends else token)) + _END * ends

    ids = {raw(t): i for t, i in model["vocab"].items() if t not in ("<|startoftext|>", "<|endoftext|>")}
    ranks = {bytes([b]): b for b in range(256)}
    for b in range(255):
        ranks[bytes([b]) + _END] = 256 + b
    pairs = []
    for i, merge in enumerate(model["merges"]):
        a, b = map(raw, merge if isinstance(merge, list) else merge.split(" "))
        pairs.append((a, b))
        ranks.setdefault(a + b, 512 + i)
    return ranks, ids, frozenset(pairs)


@lru_cache(maxsize=2)
def unlisted_tokens(path: str) -> frozenset[bytes]:
    """Tokens whose bytes, merged by joined bytes, aren't reached by listed pairs alone."""
    ranks, _, pairs = vocabulary(path)
    odd = set()
    for token in ranks:
        if len(token) == 1 or len(token) == 2 and token.endswith(_END):
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        if parts[-1] == _END:
            parts[-2:] = [parts[-2] + _END]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            pair = parts[best], parts[best + 1]
            if pair[0] + pair[1] not in ranks or pair not in pairs:
                odd.add(token)
                break
            parts[best : best + 2] = [pair[0] + pair[1]]
    return frozenset(odd)


class _Chunks(dict):
    """Packed ids by chunk, learned at the first look."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        packed = self.learn(chunk)
        if len(chunk) <= byte_bpe.CACHE_CHARS:
            self[chunk] = packed
        return packed


class WordBpe:
    """Encoder of whole texts; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, odd: frozenset[bytes] | None = None):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        ranks, ids, _ = vocabulary(path)
        odd = unlisted_tokens(path) if odd is None else odd
        self.core = tiktoken.Encoding("word", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        #: Packed id by rank; None where the library has to decide.
        self.packed = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            if token in ids and token not in odd:
                self.packed[rank] = int(ids[token]).to_bytes(4, "little")
        self.chunks = _Chunks(self._learn)
        self.marks = {c: self._piece(c) for c in ".,;:!?)|"}

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token; a TypeError tells that the library has to decide."""
        return b"".join(map(self.packed.__getitem__, self.core.encode_single_piece(piece.encode() + _END)))

    def _learn(self, chunk: str) -> bytes:
        try:
            if chunk.isascii() and chunk.isalpha():
                return self._piece(chunk.lower())
            if "<|" not in chunk and not _BEYOND.search(chunk):  # else special tokens, or what only the library folds
                if chunk[-1:] in self.marks and chunk[:-1].isalpha():
                    return self.chunks[chunk[:-1]] + self.marks[chunk[-1]]
                return b"".join(map(self._piece, self.find(chunk.lower())))
        except TypeError:
            pass
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if len(self.chunks) > byte_bpe.CACHE_ENTRIES:
                self.chunks = _Chunks(self._learn)
            parts = filter(None, _SPACE.split(t)) if _SEPARATORS.search(t) else t.split()
            out.append(b"".join(map(self.chunks.__getitem__, parts)))
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str, odd: frozenset[bytes] | None = None) -> WordBpe:
    return WordBpe(path, odd)
